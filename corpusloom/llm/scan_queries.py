"""Queries of problem 2."""

from pyspark.sql import functions as F

from corpusloom.llm.scans import repair_scans, scan_decisions
from corpusloom.session import read_table, written


def _scanned(points):
    """Fields that come from scanned pages: the ocr_text of scans, and the text of those that have no other. Labels in figures are no pages."""
    facts = ["id", F.coalesce("doc_id", "source_path").alias("doc"), "page"]
    ocr = points.filter((F.col("modality") == "scan") & F.col("ocr_text").isNotNull()).select(*facts, F.lit("ocr_text").alias("field_name"), F.col("ocr_text").alias("text"))
    plain = points.filter((F.col("modality") == "scan") & F.col("ocr_text").isNull() & F.col("text").isNotNull())
    return ocr.unionByName(plain.select(*facts, F.lit("text").alias("field_name"), "text"))


def _decided(spark, d):
    points = read_table(spark, d, "points")
    clean = points.filter((F.col("modality") != "scan") & F.col("text").isNotNull()).select("text")
    scanned = _scanned(points)
    return scanned, scan_decisions(scanned, clean)


def p2_found(spark, d):
    return _decided(spark, d)[1].select("id", "field_name", "line_no", "kind").distinct()


def p2_repaired(spark, d):
    scanned, decisions = _decided(spark, d)
    return repair_scans(scanned, written(decisions, "decisions"))


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired}
SQL = {}
