"""Queries of problem 7."""

from pyspark.sql import functions as F

from corpusloom.llm.sentences import sentence_rows
from corpusloom.session import read_table


def p7_sentences(spark, d):
    return sentence_rows(read_table(spark, d, "chunks"), "chunk_id", "text").withColumnRenamed("id", "chunk_id")


def p7_found(spark, d):
    return p7_sentences(spark, d).select(F.col("chunk_id").cast("long").alias("chunk_id"), "end_pos")


QUERIES = {"p7_found": p7_found, "p7_sentences": p7_sentences}
SQL = {}
