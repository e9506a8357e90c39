"""Queries of problem 1."""

from corpusloom.llm.near_duplicates import SimilarTexts
from corpusloom.session import read_table


def p1_found(spark, d):
    return SimilarTexts(read_table(spark, d, "points"), "id", "text", threshold=0.7).pairs()


def p1_groups(spark, d):
    """The group of every point with a text, and how many other texts its own is linked to."""
    return SimilarTexts(read_table(spark, d, "points"), "id", "text", threshold=0.7).groups()


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
SQL = {}
