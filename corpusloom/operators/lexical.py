"""Lexical search: BM25 over tokenised texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import blank_to_null
from corpusloom.session import fresh_path, spread, written

K1, B = 1.2, 0.75


def bm25_text(title: Column, text: Column, ocr_text: Column, keywords: Column) -> Column:
    """The searchable text of a point: trimmed parts that are not blank, one a line; keywords joined by spaces."""
    parts = [title, text, ocr_text, F.array_join(keywords, " ")]
    return F.concat_ws("\n", *[blank_to_null(p) for p in parts])


SEARCHABLE = ("section_title", "text", "ocr_text", "keywords")


def searchable(df: DataFrame) -> Column:
    """The searchable text of rows by the columns they have; null where there is none."""
    have = {c: F.col(c) if c in df.columns else F.lit(None).cast("array<string>" if c == "keywords" else "string") for c in SEARCHABLE}
    # White space around is of no matter to words, so nothing is trimmed as bm25_text does.
    whole = F.concat_ws("\n", *[F.array_join(have[c], " ") if c == "keywords" else have[c] for c in SEARCHABLE])
    return F.when(whole.rlike(r"(?U)\S"), whole)


def terms(t: Column) -> Column:
    """Small letters and digits between anything else."""
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_terms(text: str) -> list[str]:
    import re

    return sorted({w for w in re.split(r"[\W_]+", text.lower()) if w})


def _is(word: str):
    return lambda x: x == F.lit(word)


def bm25_scores(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text", allowed: Column | None = None) -> DataFrame:
    """id, score of texts with at least one word of the query; counts are those of the whole collection, `allowed` filters after.

    One pass makes, for each text, its length and how often each asked word occurs; only these numbers move. Null texts are no part
    of the collection; a query without words finds nothing.
    """
    asked = query_terms(query)
    ts = terms(F.col(f"`{text_col}`"))
    counted = spread(docs).filter(F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), ts.alias("ts"), (allowed if allowed is not None else F.lit(True)).alias("allowed")
    )
    tf = [F.size(F.filter("ts", _is(w))).alias(f"tf{i}") for i, w in enumerate(asked)]
    counted = counted.select("id", "allowed", F.size("ts").alias("dl"), *tf)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))])
    if not asked:
        return counted.select("id", F.lit(0.0).alias("score")).limit(0)
    hit = counted.filter(F.col("allowed") & (sum((F.col(f"tf{i}") for i in range(len(asked))), F.lit(0)) > 0))
    score = F.lit(0.0)
    for i in range(len(asked)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score += idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # The one row of statistics goes to every task.
    one = F.lit(1).alias("one")
    return hit.select("*", one).join(F.broadcast(stats.select("*", one)), "one").select("id", score.alias("score"))


class LexicalIndex:
    """An inverted index of texts in the shared folder, for collections that are searched often: texts are split into words once.

    postings: term, id, tf, dl, in buckets of their term and sorted by it, so that a search reads the row groups of its few terms. A
    common term's postings are in many files. Null texts are no part of the collection.
    """

    def __init__(self, docs: DataFrame, id_col: str = "id", text_col: str = "text", buckets: int = 16):
        self.spark, self.buckets = docs.sparkSession, buckets
        split = spread(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL"))
        counted = split.select("id", terms(F.col("text")).alias("ts")).select("id", F.size("ts").alias("dl"), "ts")
        self.lengths = written(counted.select("id", "dl"), "lengths")
        # Grouped by text as well as by word, so a common word is spread over all tasks.
        rows = counted.select("id", "dl", F.explode("ts").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf")).withColumn("bucket", self._bucket(F.col("term")))
        self.path = fresh_path(self.spark, "postings")
        rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(self.path)
        self.postings = self.spark.read.parquet(self.path) if counted.limit(1).count() else rows

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.hash(term), F.lit(self.buckets))

    def scores(self, query: str) -> DataFrame:
        """id, score of texts with at least one word of the query, as bm25_scores has them."""
        asked = query_terms(query)
        if not asked:
            return self.lengths.select("id", F.lit(0.0).alias("score")).limit(0)
        at = [r[0] for r in self.spark.createDataFrame([(w,) for w in asked], "term string").select(self._bucket(F.col("term"))).distinct().collect()]
        hit = self.postings.filter(F.col("bucket").isin(at) & F.col("term").isin(asked))
        df = hit.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the query
        stats = self.lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        one = F.lit(1).alias("one")
        facts = df.select("*", one).join(F.broadcast(stats.select("*", one)), "one").drop("one")
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return hit.join(F.broadcast(facts), "term").groupBy("id").agg(F.sum(part).alias("score"))
