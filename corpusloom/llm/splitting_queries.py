"""Queries of problem 4."""

from corpusloom.llm.splitting import split_oversized
from corpusloom.session import read_table


def p4_pieces(spark, d):
    return split_oversized(read_table(spark, d, "chunks"), read_table(spark, d, "chunk_configs"))


def p4_found(spark, d):
    return p4_pieces(spark, d).filter("piece_no = 0").select("chunk_id", "cut_kind")


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces}
SQL = {}
