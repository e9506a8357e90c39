"""Queries of problem 8."""

from pyspark.sql import functions as F

from corpusloom.llm.packing import CAPACITY, pack_texts
from corpusloom.session import read_table


def p8_packed(spark, d):
    return pack_texts(read_table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_sequences(spark, d):
    """Items, tokens and unused places of every sequence."""
    used = p8_packed(spark, d).filter(F.col("sequence_id").isNotNull()).groupBy("sequence_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return used.withColumn("unused", F.lit(CAPACITY) - F.col("n_tokens"))


QUERIES = {"p8_packed": p8_packed, "p8_sequences": p8_sequences}
SQL = {}
