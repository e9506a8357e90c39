"""Evaluation texts inside corpus documents (problem 9).

A window of w consecutive words of an item can only be found where all its words are, so its prefix is its rarest word alone.
Documents are probed at the places of such words; the place of the word in the window bounds where the window must lie, and the
window's words are compared one by one.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import spread, written

#: Words of items up to which their index is sent to all executors (some hundred bytes each); beyond, documents and windows meet by
#: their rarest words in a shuffle.
MOST_WORDS = 500_000
WORD = re.compile(r"[^\W_]+")
_SPLIT = r"[^\p{L}\p{N}]+"


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


def _with_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ws: the same words by expressions."""
    ws = F.filter(F.split(F.lower(F.col(f"`{text_col}`")), _SPLIT), lambda x: x != "")
    return df.select(F.col(f"`{id_col}`").alias("id"), ws.alias("ws")).filter(F.col("id").isNotNull() & F.col("ws").isNotNull())


def _windows(df: DataFrame, width: int) -> DataFrame:
    """id, at (from 0), window: all runs of width words."""
    starts = F.when(F.size("ws") >= width, F.sequence(F.lit(0), F.size("ws") - width)).otherwise(F.array().cast("array<int>"))
    return df.select("id", F.posexplode(F.transform(starts, lambda i: F.slice(F.col("ws"), i + 1, width))).alias("at", "window"))


def rarest_words(windows: DataFrame, documents: DataFrame, doc_id: str, text_col: str, small: bool) -> DataFrame:
    """windows with `place`, where its rarest word stands, and that word: least corpus count first, then the word itself. small: their
    words are few enough to be sent to every task, so only they are counted; else all words are, and meet in a shuffle."""
    send = F.broadcast if small else lambda x: x
    terms = windows.select(F.explode("window").alias("term")).distinct()
    in_corpus = _with_words(documents, doc_id, text_col).select(F.explode("ws").alias("term"))
    counts = in_corpus.join(send(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    placed = windows.select("id", "at", "window", F.posexplode("window").alias("place", "term")).join(send(counts), "term", "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "place"))
    return placed.groupBy("id", "at", "window").agg(best.alias("b")).select("id", "at", "window", "b.place", "b.term")


def _meeting(windows: DataFrame, documents: DataFrame, doc_id: str, text_col: str, width: int) -> DataFrame:
    """id, item, at: as _probing finds them. Places of the windows' rarest words in the documents meet the windows; where a window then
    must begin and end bounds the places, and the words there are compared."""
    docs = _with_words(documents, doc_id, text_col).select(F.col("id").cast("long").alias("id"), "ws")
    spots = docs.select("id", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "term"))
    spots = spots.join(windows.select("term").distinct(), "term", "left_semi")
    mine = windows.select("term", "place", "window", F.col("id").cast("long").alias("item"), "at")
    low = F.col("pos") - F.col("place")
    near = spots.join(mine, "term").filter((low >= 0) & (low + width <= F.col("n"))).select("id", low.alias("low"), "item", "at", "window")
    hits = near.join(docs, "id").filter(F.slice("ws", F.col("low") + 1, F.lit(width)) == F.col("window"))
    return hits.select("id", "item", F.col("at").cast("int").alias("at"))


def _index(items, width: int) -> dict:
    """word -> (place, window, [(item, at)]) from (item, words, places of the rarest words, window by window)."""
    grouped: dict = {}
    for item, ws, places in items:
        for at, place in enumerate(places):
            grouped.setdefault((place, tuple(ws[at : at + width])), []).append((item, at))
    index: dict = {}
    for (place, window), owners in grouped.items():
        index.setdefault(window[place], []).append((place, list(window), sorted(owners)))
    return index


def _probing(sent, width: int):
    """(id, text) -> (id, item, at): a window of item beginning at its word `at` stands in the text."""

    def run(batches):
        index = _index(sent.value, width)
        for batch in batches:
            ids, items, ats = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ws = words(text)
                for p, word in enumerate(ws):
                    entries = index.get(word)
                    if entries is None:
                        continue
                    for place, window, owners in entries:
                        low = p - place
                        if low >= 0 and low + width <= len(ws) and ws[low : low + width] == window:
                            for item, at in owners:
                                ids.append(i)
                                items.append(item)
                                ats.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(items, pa.int64()), pa.array(ats, pa.int32())], ["id", "item", "at"])

    return run


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", width: int = 15,
) -> DataFrame:
    """doc_id, item_id, words_found, share: documents that share with an item at least width consecutive words.

    words_found counts the item's word places that some shared window covers; share divides it by the item's words. Texts that
    are null, or items shorter than width words, share nothing; equal documents each have their rows; ids are whole numbers.
    """
    spark = documents.sparkSession
    item_words = _with_words(items, item_id, text_col)
    # Items are told apart by id and text, as ids may come again.
    item_words = item_words.withColumn("key", F.xxhash64("id", "ws"))
    windows = _windows(item_words.select(F.col("key").alias("id"), "ws").dropDuplicates(["id"]), width)
    small = (item_words.agg(F.sum(F.size("ws"))).first()[0] or 0) <= MOST_WORDS
    windows = written(rarest_words(windows, documents, doc_id, text_col, small), "windows")
    if small:
        places = windows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "place"))).alias("p")).select("id", F.transform("p", lambda x: x["place"]).alias("places"))
        told = item_words.dropDuplicates(["key"]).select("key", F.col("id").cast("long").alias("item"), "ws")
        table = told.join(places.withColumnRenamed("id", "key"), "key").select("item", "ws", "places").toArrow()
        sent = spark.sparkContext.broadcast(list(zip(*(table.column(c).to_pylist() for c in range(3)))))
        texts = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
        texts = texts.filter(F.col("id").isNotNull() & F.col("text").isNotNull())
        hits = spread(texts).mapInArrow(_probing(sent, width), "id long, item long, at int")
    else:
        own = item_words.select("key", F.col("id").alias("item")).distinct()
        named = windows.join(own, windows.id == own.key).select(F.col("item").alias("id"), "at", "window", "place", "term")
        hits = _meeting(named, documents, doc_id, text_col, width)
    per_pair = hits.groupBy("id", "item").agg(F.collect_set("at").alias("ats"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + width - 1)))))
    sizes = item_words.select(F.col("id").cast("long").alias("item"), F.size("ws").alias("n_words"))
    out = per_pair.select("id", "item", covered.alias("words_found")).join(sizes, "item")
    return out.select(F.col("id").alias("doc_id"), F.col("item").cast("int").alias("item_id"), "words_found", F.round(F.col("words_found") / F.col("n_words"), 6).alias("share"))
