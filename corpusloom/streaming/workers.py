"""Streams: workers that answer requests, request and reply matching, sessions, telemetry, idempotent sinks.

Every function takes a streaming DataFrame of any source (a broker where its connector is there, files in tests) with the columns of
ENVELOPE; offsets and state live in the query's checkpoint, so a restart goes on where the last commit ended.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQueryListener

from corpusloom.functions.text import blank_to_null
from corpusloom.operators.messages import strict_json

ENVELOPE = "topic string, partition int, offset long, key string, value string, headers map<string,string>, timestamp timestamp"
PROCESS_REQUEST = "uuid string, url_download string, lang string, timeout_seconds int, correlation_id string"
PROCESS_FIELDS = ["uuid", "url_download", "lang", "timeout_seconds", "correlation_id"]


def file_stream(spark: SparkSession, folder: str, schema: str = ENVELOPE, files_per_trigger: int = 100) -> DataFrame:
    """Messages from JSON files, from the earliest on."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def broker_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Messages of a topic, from the earliest on; needs the broker's connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("includeHeaders", "true").load()
    headers = F.map_from_entries(F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string"))))
    return raw.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), headers.alias("headers"), "timestamp")


def published(rows: DataFrame, key: str, source_topic: str) -> DataFrame:
    """key, value (all columns as JSON), headers, for a broker's or a file sink."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"), F.create_map(F.lit("source_topic"), F.lit(source_topic)).alias("headers"))


def _many(model: Callable):
    """UDF over arrays: all items of an Arrow batch are embedded at once."""

    @F.pandas_udf("array<array<float>>")
    def run(batches: pd.Series) -> pd.Series:
        flat = [x for items in batches for x in items]
        vectors, at, out = model(flat), 0, []
        for items in batches:
            out.append([v.tolist() for v in vectors[at : at + len(items)]])
            at += len(items)
        return pd.Series(out)

    return run


def embedding_replies(messages: DataFrame, model: Callable, items: str = "texts") -> DataFrame:
    """key, value, headers of the replies to {"texts": [...]} messages: status, message, count, dimension, embeddings. The key is kept and
    the body has no correlation id. Messages that don't parse, or hold nothing, get a failed reply."""
    asked = messages.withColumn("items", F.from_json("value", f"{items} array<string>")[items])
    bad = F.col("items").isNull() | (F.size("items") == 0) | F.exists("items", lambda x: blank_to_null(x).isNull())
    vectors = F.when(~bad, _many(model)(F.when(bad, F.array(F.lit("-"))).otherwise(F.col("items"))))
    made = asked.select("topic", "key", "timestamp", bad.alias("bad"), vectors.alias("embeddings"))
    body = F.struct(
        F.when(F.col("bad"), "failed").otherwise("ok").alias("status"), F.when(F.col("bad"), "no usable items").alias("message"), F.coalesce(F.size("embeddings"), F.lit(0)).alias("count"),
        F.coalesce(F.size(F.col("embeddings")[0]), F.lit(0)).alias("dimension"), "embeddings", F.col("timestamp").alias("at"),
    )
    return made.select("key", F.to_json(body).alias("value"), F.create_map(F.lit("source_topic"), F.col("topic")).alias("headers"), "timestamp")


def process_requests(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decoded process requests (correlation id from body, header or key) and the malformed messages, for a dead-letter sink."""
    r = messages.withColumn("r", strict_json(F.col("value"), PROCESS_REQUEST, PROCESS_FIELDS))
    cid = F.coalesce(blank_to_null(F.col("r.correlation_id")), blank_to_null(F.col("headers")["correlation_id"]), blank_to_null(F.col("key")))
    good = r.filter(F.col("r").isNotNull()).select("topic", "partition", "offset", "timestamp", "r.uuid", "r.url_download", "r.lang", F.coalesce(F.when(F.col("r.timeout_seconds") > 0, F.col("r.timeout_seconds")), F.lit(180)).alias("timeout_seconds"), cid.alias("correlation_id"))
    return good, r.filter(F.col("r").isNull()).drop("r")


def awaited_replies(requests: DataFrame, replies: DataFrame, seconds: int = 90, late: str = "2 minutes") -> DataFrame:
    """Stream-stream join of requests (cid, asked_at) and replies (cid, replied_at, status) within the deadline. State is dropped once
    the watermarks have passed it."""
    a = requests.withWatermark("asked_at", late).alias("a")
    b = replies.withWatermark("replied_at", late).alias("b")
    near = F.expr(f"b.cid = a.cid AND b.replied_at >= a.asked_at AND b.replied_at <= a.asked_at + INTERVAL {seconds} SECONDS")
    return a.join(b, near, "inner").select("a.cid", "a.asked_at", "b.replied_at", "b.status")


def windowed_counts(messages: DataFrame, labels: list[str], ts: str = "timestamp", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    w = F.window(ts, window)
    return messages.withWatermark(ts, late).groupBy(w, *labels).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *labels, "n")


def session_stream(events: DataFrame, user: str, ts: str, ttl_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    w = F.session_window(ts, f"{ttl_minutes} minutes")
    g = events.withWatermark(ts, late).groupBy(user, w).agg(F.count("*").alias("n_events"))
    return g.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("expires_at"), "n_events")


class HistoryProcessor(StatefulProcessor):
    """Chat turns of a session, appended in order; the session ends a time to live after its last turn (processing time)."""

    def __init__(self, ttl_ms: int = 1_800_000):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.count = handle.getValueState("turns", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        for batch in rows:
            n = self.count.get()[0] if self.count.exists() else 0
            batch = batch.sort_values(["timestamp", "offset"])
            turns = range(n + 1, n + 1 + len(batch))
            self.count.update((n + len(batch),))
            yield pd.DataFrame({"session_id": key[0], "turn": list(turns), "role": batch["role"].tolist(), "text": batch["text"].tolist()})

    def close(self) -> None:
        pass


def history_stream(turns: DataFrame, ttl_ms: int = 1_800_000) -> DataFrame:
    """turns (session_id, role, text, offset, timestamp) numbered within their session."""
    return turns.groupBy("session_id").transformWithStateInPandas(HistoryProcessor(ttl_ms), "session_id string, turn long, role string, text string", "Append", "ProcessingTime")


def run_available(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands all there is to handle, batch by batch. A batch counts as done when handle has returned; after a failure it comes again, so
    handle must bear repeats (a store by key does)."""
    rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def once_by_offset(batch: DataFrame) -> DataFrame:
    """A batch without repeats of the same place in the same topic."""
    return batch.dropDuplicates(["topic", "partition", "offset"])



class Progress(StreamingQueryListener):
    """Counts what the session's streams do: batches, rows, seconds, rows behind and failures, by query name."""

    def __init__(self):
        self.counts: dict[str, dict[str, float]] = {}

    def _of(self, name: str | None) -> dict[str, float]:
        return self.counts.setdefault(name or "", {"batches": 0, "rows": 0, "seconds": 0.0, "failures": 0})

    def onQueryStarted(self, event) -> None:
        self._of(event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        c = self._of(p.name)
        c["batches"] += 1
        c["rows"] += p.numInputRows
        c["seconds"] += p.batchDuration / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._of("").__setitem__("failures", self._of("")["failures"] + 1)


def upload_batches(requests: DataFrame, bucket: str, checkpoint: str, results: Callable[[DataFrame], None]) -> None:
    """Upload requests (folder, url) of a stream: each batch's local files are stored and its results (key, length) handed on. A batch
    that comes again stores the same objects again."""
    from corpusloom.sources.files import local_path, write_objects

    def handle(batch: DataFrame, _: int) -> None:
        path = F.udf(lambda u: local_path(u), "string")
        files = batch.sparkSession.read.format("binaryFile")
        rows = batch.select("folder", "url").distinct().withColumn("at", path("url"))
        paths = [r["at"] for r in rows.select("at").distinct().collect()]
        if paths:
            content = files.load(paths).select(F.regexp_replace("path", r"^file:/+", "/").alias("at"), "content")
            results(write_objects(rows.join(content, "at").select("folder", "url", "content"), bucket))

    run_available(requests, handle, checkpoint)


def ingest_batches(documents: DataFrame, collections, name: str, checkpoint: str, results: Callable[[DataFrame], None]) -> None:
    """Documents (doc_id, text, lang, source_path) of a stream, ingested batch by batch; ids come from the documents, so a repeated
    batch writes the same points."""
    from corpusloom.operators.ingest import ingest

    run_available(documents, lambda batch, _: results(ingest(batch, collections, name)), checkpoint)
