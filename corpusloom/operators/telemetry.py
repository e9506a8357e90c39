"""Counters, rates, histograms and gauges over time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of a latency histogram in seconds, the last one open: fixed values.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def label_counts(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def tumbling_rate(events: DataFrame, labels: list[str], ts: str, value: Column, seconds: int = 300) -> DataFrame:
    """labels, window_start, per_second: the sum of value in each window over its length."""
    w = F.window(F.col(ts), f"{seconds} seconds")
    return events.groupBy(*labels, w.alias("w")).agg((F.sum(value) / F.lit(float(seconds))).alias("per_second")).select(*labels, F.col("w.start").alias("window_start"), "per_second")


def counter_increase(df: DataFrame, previous: str, value: str) -> Column:
    """Increase of a counter against the sample before; after a reset the value itself, for the first sample nothing."""
    p, v = F.col(previous), F.col(value)
    return F.when(p.isNull(), F.lit(0.0)).when(v < p, v).otherwise(v - p).cast("double")


def bucket_counts(events: DataFrame, labels: list[str], value: str) -> DataFrame:
    """labels, le, n: how many values are at or below each bound (cumulative; le is null for the open one, which counts all)."""
    counts = events.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)], F.count(value).alias("all"))
    pairs = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n"))]
    return counts.select(*labels, F.explode(F.array(*pairs)).alias("x")).select(*labels, "x.le", "x.n")


def histogram_quantile(buckets: DataFrame, labels: list[str], q: float) -> DataFrame:
    """labels, value: the quantile by linear interpolation within its bucket; the largest finite bound where it falls in the open one."""
    g = buckets.groupBy(*labels).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("le", F.lit(float("inf"))).alias("le"), "n"))).alias("b"))
    rank = F.element_at("b", -1)["n"] * F.lit(q)
    first = F.filter("b", lambda x: x["n"] >= rank)[0]
    below = F.try_element_at(F.filter("b", lambda x: x["n"] < rank), F.lit(-1))
    low, before = F.coalesce(below["le"], F.lit(0.0)), F.coalesce(below["n"], F.lit(0))
    at = low + (first["le"] - low) * (rank - before) / (first["n"] - before)
    finite = F.when(first["le"] == float("inf"), F.lit(BUCKETS[-1])).otherwise(at)
    return g.select(*labels, F.when(F.element_at("b", -1)["n"] > 0, finite).alias("value"))


def latest_sum(gauges: DataFrame, job: str, series: list[str], ts: str, value: str) -> DataFrame:
    """job, total: the sum of each series' latest sample."""
    latest = gauges.groupBy(job, *series).agg(F.max_by(value, ts).alias("v"))
    return latest.groupBy(job).agg(F.sum("v").alias("total"))


def lag(high_water: Column, offset: Column) -> Column:
    return F.greatest(F.lit(0), high_water - offset)


def log_labels(line: Column, path: Column) -> tuple[Column, Column]:
    """The level of a JSON log line, and the service that its file is named after."""
    return F.get_json_object(line, "$.level"), F.nullif(F.regexp_extract(path, r".*/([a-zA-Z0-9_-]+)\.log$", 1), F.lit(""))
