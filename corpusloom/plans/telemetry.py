"""Queries on telemetry, messages and sessions."""

from pyspark.sql import functions as F

from corpusloom.operators import messages as M
from corpusloom.operators import telemetry as T
from corpusloom.operators.prefix import previous
from corpusloom.session import read_table


def _events(spark, d):
    return read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def task_counts(spark, d):
    return T.label_counts(read_table(spark, d, "embed_results").withColumn("status", F.lower("reply_status")), ["topic_name", "topic_partition", "status"])


def task_rate_5m(spark, d):
    r = T.tumbling_rate(_events(spark, d), ["event_type"], "ts", F.lit(1))
    return r.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.round("per_second", 9).alias("per_second"))


def counter_rates(spark, d):
    """Per user and hour: the increase of the running value, resets counted from zero, a second."""
    e = previous(_events(spark, d).select("user_id", "event_id", "ts", "value"), ["user_id"], "event_id", ["value"])
    e = e.withColumn("inc", T.counter_increase(e, "prev_value", "value")).withColumn("hour", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss"))
    return e.groupBy("hour").agg(F.round(F.sum("inc") / 3600.0, 6).alias("per_second"))


def latency_buckets(spark, d):
    e = _events(spark, d).withColumn("seconds", F.col("value") / 50.0)
    return T.bucket_counts(e, ["event_type"], "seconds").select("event_type", F.coalesce("le", F.lit(-1.0)).alias("le"), "n")


def latency_p95(spark, d):
    e = _events(spark, d).withColumn("seconds", F.col("value") / 50.0)
    return T.histogram_quantile(T.bucket_counts(e, ["event_type"], "seconds"), ["event_type"], 0.95).select("event_type", F.round("value", 6).alias("p95"))


def health_ratio(spark, d):
    up = F.when(F.lower("reply_status").isin("ok", "success"), 1).otherwise(0)
    return read_table(spark, d, "embed_results").groupBy("topic_name").agg(F.round(F.sum(up) / F.count("*"), 6).alias("ratio"))


def label_sums(spark, d):
    g = _events(spark, d).withColumn("shard", F.col("user_id") % 16)
    return T.latest_sum(g, "event_type", ["shard"], "event_id", "value").select("event_type", F.round("total", 4).alias("total"))


def lag_gauge(spark, d):
    e = read_table(spark, d, "embed_results")
    return e.select("topic_name", "topic_partition", "msg_offset", T.lag(F.col("msg_offset") + F.col("consumer_lag") - 5, F.col("msg_offset")).alias("lag"))


def zero_norms_by_batch(spark, d):
    """Per delivery batch: embeddings, and those without a norm."""
    e = read_table(spark, d, "embed_results").select("batch_id", F.explode("embeddings").alias("v"))
    zero = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < 1e-24
    return e.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if(zero).alias("n_zero"))


def batch_throughput(spark, d):
    """Per topic: items a second between the first and last reply, and the seconds that as many again would take."""
    e = read_table(spark, d, "embed_results").filter("replied_at IS NOT NULL")
    g = e.groupBy("topic_name").agg(F.sum("item_count").alias("items"), (F.unix_micros(F.max("replied_at")) - F.unix_micros(F.min("replied_at"))).alias("us"))
    rate = F.when(F.col("us") > 0, F.col("items") / (F.col("us") / 1e6))
    return g.select("topic_name", "items", F.round(rate, 6).alias("per_second"), F.round(F.col("items") / rate, 3).alias("eta_s"))


def log_labels_of_events(spark, d):
    line = F.concat(F.lit('{"level":"'), "event_type", F.lit('","n":'), F.col("event_id").cast("string"), F.lit("}"))
    path = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/var/logs/"), "event_type", F.lit("-svc.log"))).otherwise("/var/logs/none.txt")
    level, service = T.log_labels(line, path)
    return _events(spark, d).select("event_id", level.alias("level"), service.alias("service_name"))


def json_payload(spark, d):
    e = _events(spark, d)
    strict = M.strict_json(F.col("props"), "k long", ["k"])
    return e.select("event_id", strict["k"].alias("k"), strict.isNotNull().alias("decoded"), M.strict_json(F.col("props"), "other long", ["other"]).isNotNull().alias("other"))


def string_fields_kept(spark, d):
    """Fields of an event as JSON that are strings; numbers are left out."""
    e = _events(spark, d)
    line = F.to_json(F.struct("event_type", "value", F.col("event_id").cast("string").alias("event_id")))
    return e.select(F.col("event_id").alias("n"), F.explode(M.string_fields(line)).alias("key", "value"))


def correlation_reply(spark, d):
    """Events of one type as requests, of another as replies of the same user, within 90 minutes' worth of the reference's seconds."""
    e = _events(spark, d).select(F.col("user_id").alias("cid"), "ts", "event_type", "event_id")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    asked = e.filter(F.col("event_type") == kinds[0]).select("cid", F.col("ts").alias("asked_at"), "event_id")
    replied = e.filter(F.col("event_type") == kinds[1]).select("cid", F.col("ts").alias("replied_at"), F.when(F.col("event_id") % 5 == 0, " Failed").otherwise("ok").alias("status"))
    r = M.first_replies(asked, replied, 90 * 60)
    return r.select("event_id", F.unix_micros("replied_at").alias("replied_us"), "outcome")


def correlation_ids(spark, d):
    r = read_table(spark, d, "embed_results")
    return r.select("topic_name", "topic_partition", "msg_offset", M.resolve_id(F.col("correlation_id"), F.col("headers")["correlation_id"], F.col("msg_key")).alias("process_id"), M.resolve_id(F.col("correlation_id"), F.col("msg_key"), F.col("headers")["correlation_id"]).alias("reply_id"))


def session_ttl(spark, d):
    s = M.sessions(_events(spark, d), "user_id", "ts")
    return s.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n_events")


QUERIES = {
    f.__name__: f
    for f in (
        task_counts, task_rate_5m, counter_rates, latency_buckets, latency_p95, health_ratio, label_sums, lag_gauge, zero_norms_by_batch, batch_throughput, log_labels_of_events, json_payload,
        string_fields_kept, correlation_reply, correlation_ids, session_ttl,
    )
}

_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_C = lambda x: f"nullif(regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g'), '')"
_BOUNDS = ", ".join(f"({b}::DOUBLE)" for b in T.BUCKETS)
_BUCKETS = f"""b AS (SELECT event_type, le, count(*) FILTER (value / CAST(50 AS DOUBLE) <= le) AS n FROM events, (VALUES {_BOUNDS}) t(le) GROUP BY event_type, le
 UNION ALL SELECT event_type, 'inf'::DOUBLE, count(value) FROM events GROUP BY event_type)"""
SQL = {
    "task_counts": "SELECT topic_name, topic_partition, lower(reply_status) AS status, count(*) AS n FROM embed_results GROUP BY ALL",
    "task_rate_5m": "SELECT event_type, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS window_start, round(count(*) / CAST(300 AS DOUBLE), 9) AS per_second FROM events GROUP BY event_type, time_bucket(INTERVAL 5 MINUTE, ts)",
    "counter_rates": """WITH p AS (SELECT ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS pv FROM events)
 SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, round(sum(CASE WHEN pv IS NULL THEN 0 WHEN value < pv THEN value ELSE value - pv END) / 3600, 6) AS per_second FROM p GROUP BY date_trunc('hour', ts)""",
    "latency_buckets": f"WITH {_BUCKETS} SELECT event_type, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, n FROM b",
    "latency_p95": f"""WITH {_BUCKETS}, t AS (SELECT event_type, max(n) * CAST(0.95 AS DOUBLE) AS r FROM b GROUP BY event_type),
 f AS (SELECT event_type, r, min_by(le, le) FILTER (n >= r) AS le, min(n) FILTER (n >= r) AS n, coalesce(max(le) FILTER (n < r), 0) AS low, coalesce(max(n) FILTER (n < r), 0) AS before FROM b JOIN t USING (event_type) GROUP BY event_type, r)
 SELECT event_type, round(CASE WHEN isinf(le) THEN 10 ELSE low + (le - low) * (r - before) / (n - before) END, 6) AS p95 FROM f""",
    "health_ratio": "SELECT topic_name, round(count(*) FILTER (lower(reply_status) IN ('ok', 'success')) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM embed_results GROUP BY topic_name",
    "label_sums": "SELECT event_type, round(sum(v), 4) AS total FROM (SELECT event_type, user_id % 16 AS shard, max_by(value, event_id) AS v FROM events GROUP BY ALL) GROUP BY event_type",
    "lag_gauge": "SELECT topic_name, topic_partition, msg_offset, greatest(0, consumer_lag - 5) AS lag FROM embed_results",
    "zero_norms_by_batch": """SELECT batch_id, count(*) AS n, count(*) FILTER (list_sum(list_transform(v::DOUBLE[], lambda x: x * x)) < 1e-24) AS n_zero
 FROM (SELECT batch_id, unnest(embeddings) AS v FROM embed_results) GROUP BY batch_id""",
    "batch_throughput": """SELECT topic_name, sum(item_count)::BIGINT AS items, round(sum(item_count) / (CAST(epoch_us(max(replied_at)) - epoch_us(min(replied_at)) AS DOUBLE) / 1e6), 6) AS per_second,
 round(CAST(epoch_us(max(replied_at)) - epoch_us(min(replied_at)) AS DOUBLE) / 1e6, 3) AS eta_s FROM embed_results WHERE replied_at IS NOT NULL GROUP BY topic_name""",
    "log_labels_of_events": "SELECT event_id, event_type AS level, CASE WHEN event_id % 2 = 0 THEN event_type || '-svc' END AS service_name FROM events",
    "json_payload": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS decoded, false AS other FROM events",
    "string_fields_kept": "SELECT event_id AS n, 'event_type' AS key, event_type AS value FROM events UNION ALL SELECT event_id, 'event_id', event_id::VARCHAR FROM events",
    "correlation_reply": """WITH k AS (SELECT list_sort(list(DISTINCT event_type)) AS k FROM events), a AS (SELECT user_id, ts, event_id FROM events, k WHERE event_type = k[1]),
 b AS (SELECT user_id, ts, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events, k WHERE event_type = k[2]),
 j AS (SELECT a.event_id, b.ts, b.status, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts NULLS LAST, b.status) AS rn FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 90 MINUTE)
 SELECT event_id, epoch_us(ts) AS replied_us, CASE WHEN ts IS NULL THEN 'timeout' ELSE status END AS outcome FROM j WHERE rn = 1""",
    "correlation_ids": f"""SELECT topic_name, topic_partition, msg_offset, coalesce({_C('correlation_id')}, {_C("headers['correlation_id']")}, {_C('msg_key')}) AS process_id,
 coalesce({_C('correlation_id')}, {_C('msg_key')}, {_C("headers['correlation_id']")}) AS reply_id FROM embed_results""",
    "session_ttl": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_events FROM s GROUP BY user_id, k""",
}
