"""Queries of problem 10."""

from pyspark.sql import functions as F

from corpusloom.llm.language_queries import language_models
from corpusloom.llm.languages import detect_languages
from corpusloom.llm.reading_levels import graded_sample, reading_levels, trained
from corpusloom.session import read_table


def _levels(spark, d):
    documents = read_table(spark, d, "documents")
    model = trained(spark, graded_sample(documents, read_table(spark, d, "level_labels")))
    found = detect_languages(documents.select(F.col("doc_id").cast("string").alias("key"), "text"), language_models(spark, d), text=True)
    only = found.filter((F.col("lang") == "en") & F.forall("segments", lambda s: s["lang"] == "en"))
    return reading_levels(only.select(F.col("key").cast("long").alias("doc_id"), "text"), model)


def p10_found(spark, d):
    return _levels(spark, d).select("doc_id", "grade")


def p10_profile(spark, d):
    """Documents and mean difficulty by source and grade."""
    sources = read_table(spark, d, "documents").select("doc_id", "source")
    levels = _levels(spark, d).join(sources, "doc_id")
    return levels.groupBy("source", "grade").agg(F.count("*").alias("n_docs"), F.round(F.avg("difficulty"), 6).alias("mean_difficulty"))


QUERIES = {"p10_found": p10_found, "p10_profile": p10_profile}
SQL = {}
