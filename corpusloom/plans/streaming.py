"""Streams run to the end of what there is, and queries on ingest. Tables become message files in the shared folder first."""

from pyspark.sql import functions as F

from corpusloom.functions.models import hash_embedding
from corpusloom.operators.chunking import ChunkConfig
from corpusloom.operators.collection import Collections, CollectionSchema, VectorConfig
from corpusloom.operators.delivery import REPLY_ORDER, MessageStore, message_identifier
from corpusloom.operators.ingest import ingest, points_of_documents, tallies, upload
from corpusloom.session import fresh_path, read_table
from corpusloom.streaming import workers as W


def _streamed(df, name):
    """df as message files and the stream that reads them."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _drained(stream, name):
    """All that the stream gives until its source is used up, as a table."""
    spark, out = stream.sparkSession, fresh_path(stream.sparkSession, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_path(spark, f"{name}-checkpoint")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _envelope(key, value, timestamp):
    return [F.lit("in").alias("topic"), F.lit(0).alias("partition"), F.xxhash64(key).alias("offset"), key.cast("string").alias("key"), value.alias("value"), F.create_map(F.lit("source"), F.lit("t")).alias("headers"), timestamp.alias("timestamp")]


def stream_embedding_replies(spark, d):
    c = read_table(spark, d, "chunks")
    value = F.when(F.col("chunk_id") % 7 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.array("text", F.lit("one more")).alias("texts"))))
    messages = _streamed(c.select(*_envelope(F.col("chunk_id"), value, F.timestamp_seconds(F.col("chunk_id")))), "embed-requests")
    out = _drained(W.embedding_replies(messages, hash_embedding), "embed-replies")
    body = F.from_json("value", "status string, count int, dimension int")
    return out.select(F.col("key").cast("long").alias("chunk_id"), body["status"].alias("status"), body["count"].cast("long").alias("n"), body["dimension"].cast("long").alias("dimension"))


def stream_process_requests(spark, d):
    r = read_table(spark, d, "process_requests").filter("requested_at IS NOT NULL")
    fields = [F.col(c) for c in ("uuid", "url_download", "lang", "timeout_seconds", "correlation_id")]
    odd = F.substring("uuid", 1, 1).isin("0", "a")
    value = F.when(odd, F.to_json(F.struct(*fields, F.lit(1).alias("extra")))).otherwise(F.to_json(F.struct(*fields)))
    messages = _streamed(r.select(*_envelope(F.col("uuid"), value, F.col("requested_at"))), "process-requests")
    good, _ = W.process_requests(messages)
    return _drained(good, "process").select("uuid", F.col("timeout_seconds").cast("long").alias("timeout_seconds"), "correlation_id", F.unix_micros("timestamp").alias("at_us"))


def _events(spark, d):
    e = read_table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), "user_id", "event_type")
    # One event of nobody, months later, moves the watermark past all others.
    last = e.agg((F.max("timestamp") + F.expr("INTERVAL 80 DAYS")).alias("timestamp")).select(F.lit(-1).cast("long").alias("event_id"), "timestamp", F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"))
    return e.unionByName(last)


def stream_windowed_counts(spark, d):
    s = W.windowed_counts(_streamed(_events(spark, d), "events"), ["event_type"], late="40 days")
    return _drained(s, "counts").filter("event_type <> 'end'").select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


def stream_sessions(spark, d):
    s = W.session_stream(_streamed(_events(spark, d), "events"), "user_id", "timestamp", late="40 days")
    return _drained(s, "sessions").filter("user_id >= 0").select("user_id", F.unix_micros("session_start").alias("start_us"), "n_events")


def stream_replies_awaited(spark, d):
    e = _events(spark, d).filter("event_id >= 0")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    asked = _streamed(e.filter(F.col("event_type") == kinds[0]).select(F.col("user_id").alias("cid"), F.col("timestamp").alias("asked_at")), "asked")
    replied = _streamed(e.filter(F.col("event_type") == kinds[1]).select(F.col("user_id").alias("cid"), F.col("timestamp").alias("replied_at"), F.lit("ok").alias("status")), "replied")
    out = _drained(W.awaited_replies(asked, replied, 5400, "40 days"), "matched")
    return out.select("cid", F.unix_micros("asked_at").alias("asked_us"), F.unix_micros("replied_at").alias("replied_us"), "status")


def stream_deduplicated(spark, d):
    """One row of every reply, upserted batch by batch as they come; every batch twice, as after a failure."""
    store = MessageStore(spark, message_identifier(F.col("correlation_id"), F.col("msg_key"), F.col("headers")), REPLY_ORDER)
    replies = _streamed(read_table(spark, d, "embed_results"), "replies")

    def handle(batch, _):
        store.upsert(batch)
        store.upsert(batch)

    W.run_available(replies, handle, fresh_path(spark, "replies-checkpoint"))
    kept = store.compacted()
    store.close()
    return kept.select(
        F.col("identifier").alias("message_id"), "copies", F.col("item.topic_name"), F.col("item.topic_partition").cast("long").alias("topic_partition"), F.col("item.msg_offset").alias("msg_offset")
    )


def ingest_points(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang", F.col("source").alias("source_path"))
    p = points_of_documents(docs, ChunkConfig(similarity=0.3))
    return p.select("id", "doc_id", "chunk_index", "token_count", "has_figure", F.size("text_dense").alias("dim"), "text")


def ingest_tallies(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang", F.col("source").alias("source_path"))
    return tallies(points_of_documents(docs))


def ingest_verified(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang", F.col("source").alias("source_path"))
    return ingest(docs, Collections(spark, fresh_path(spark, "collections")), "ingested")


def batched_upload(spark, d):
    """Vectors in batches of 20, some without items, and one of another length in the second upload."""
    e = read_table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("id"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("text_dense"))
    spoilt = e.withColumn("text_dense", F.when(F.col("vec_id") == 437, F.slice("text_dense", 1, 3)).otherwise(F.col("text_dense")))
    collections, out = Collections(spark, fresh_path(spark, "collections")), None
    for k, (rows, schema) in enumerate(((e, "whole"), (spoilt, "broken"))):
        made = upload(rows, collections, CollectionSchema(schema, [VectorConfig("text_dense", 64)]), "vec_id")
        made = made.select(F.lit(k).cast("long").alias("upload_no"), "*", F.lit(collections.count(schema)).cast("long").alias("n_there"))
        out = made if out is None else out.unionByName(made)
    return out


QUERIES = {
    f.__name__: f
    for f in (stream_embedding_replies, stream_process_requests, stream_windowed_counts, stream_sessions, stream_replies_awaited, stream_deduplicated, ingest_points, ingest_tallies, ingest_verified, batched_upload)
}
_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_C = lambda x: f"nullif(regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g'), '')"
SQL = {
    "batched_upload": """WITH g AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings WHERE vec_id % 7 <> 0),
 f AS (SELECT (min(r) FILTER (vec_id = 437) - 1) // 20 AS failed, count(*) AS n FROM g)
 SELECT 0::BIGINT AS upload_no, true AS success, n AS n_inserted, (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0) AS n_skipped, NULL::BIGINT AS failed_batch, n AS n_there FROM f
 UNION ALL SELECT 1, failed IS NULL, coalesce(failed * 20, n)::BIGINT, (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0), failed, coalesce(failed * 20, n)::BIGINT FROM f""",
    "stream_embedding_replies": f"""SELECT chunk_id, CASE WHEN bad THEN 'failed' ELSE 'ok' END AS status, CASE WHEN bad THEN 0 ELSE 2 END AS n, CASE WHEN bad THEN 0 ELSE 64 END AS dimension
 FROM (SELECT chunk_id, chunk_id % 7 = 0 OR {_C('text')} IS NULL AS bad FROM chunks)""",
    "stream_process_requests": f"""SELECT uuid, CASE WHEN timeout_seconds > 0 THEN timeout_seconds ELSE 180 END::BIGINT AS timeout_seconds, coalesce({_C('correlation_id')}, uuid) AS correlation_id,
 epoch_us(requested_at) AS at_us FROM process_requests WHERE requested_at IS NOT NULL AND uuid[1] NOT IN ('0', 'a')""",
    "stream_windowed_counts": "SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n_events FROM s GROUP BY user_id, k""",
    "stream_replies_awaited": """WITH k AS (SELECT list_sort(list(DISTINCT event_type)) AS k FROM events) SELECT a.user_id AS cid, epoch_us(a.ts) AS asked_us, epoch_us(b.ts) AS replied_us, 'ok' AS status
 FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 90 MINUTE, k WHERE a.event_type = k[1] AND b.event_type = k[2]""",
    "stream_deduplicated": f"""WITH m AS (SELECT *, coalesce({_C('correlation_id')}, {_C('msg_key')}, {_C("headers['correlation_id']")}) AS message_id FROM embed_results)
 SELECT message_id, CASE WHEN message_id IS NULL THEN 1 ELSE n END AS copies, topic_name, topic_partition::BIGINT AS topic_partition, msg_offset
 FROM (SELECT *, count(*) OVER (PARTITION BY message_id) AS n, row_number() OVER (PARTITION BY message_id
 ORDER BY replied_at NULLS LAST, topic_name NULLS LAST, topic_partition NULLS LAST, msg_offset NULLS LAST) AS rn FROM m) WHERE rn = 1 OR message_id IS NULL""",
}
