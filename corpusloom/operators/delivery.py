"""Messages delivered at least once: an idempotent store that keeps one copy of each.

The store is a set of runs, hash-bucketed and sorted by message. An upsert collapses its batch map-side and adds a run; compaction
merges runs pair by pair, bucket by bucket, as sorted streams that meet by key, without a shuffle or a sort of what is read, and
the merged run takes their place. Beside the messages stand their deliveries, bucketed by message and delivery together, so a message
that was delivered a thousand million times fills no single bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import drop_path, fresh_name, fresh_path

BLANK_ENDS = r"(?U)^\s+|\s+$"


def cleaned(c: Column) -> Column:
    """Without Unicode white space around; null where nothing is left."""
    return F.nullif(F.regexp_replace(c, BLANK_ENDS, ""), F.lit(""))


def message_identifier(body: Column, key: Column, headers: Column, header: str = "correlation_id") -> Column:
    """The first that is not blank of the body's identifier, the message's key and the header."""
    return F.coalesce(cleaned(body), cleaned(key), cleaned(headers[header]))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType)) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


class MessageStore:
    """Bucketed, sorted runs with one row per message.

    key: identifier, nullable; rows where it is null are all kept, equal ones too. order: columns that rank the copies of a message;
    the least is kept, nulls last, and the whole row's hash decides ties.

    A delivery is a row as it was delivered, with all its columns. Equal rows within an upsert are as many deliveries; a row that
    another upsert has brought already, as often, is the same deliveries again. So repeating an upsert, or bringing the same rows in
    other parts or order, leaves the same messages and the same counts, as long as rows equal in all columns come together.
    """

    def __init__(self, spark: SparkSession, key: Column, order: list[str], buckets: int | None = None):
        self.spark, self.key, self.order = spark, key, order
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.columns: list[str] | None = None
        #: (table, path) of the runs of messages and of deliveries.
        self.runs: dict[str, list[tuple[str, str]]] = {"messages": [], "deliveries": []}

    _KEYS = {"messages": ["store_key"], "deliveries": ["store_key", "delivery"]}

    def _planned(self, action):
        """action() with as many shuffle partitions as buckets, so that each bucket of a run is one file, and with the order of such
        files known to the planner."""
        conf = self.spark.conf
        names = {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
        before = {n: conf.get(n, None) for n in names}
        try:
            for n, v in names.items():
                conf.set(n, v)
            return action()
        finally:
            for n, v in before.items():
                conf.set(n, v) if v is not None else conf.unset(n)

    def _write(self, kind: str, rows: DataFrame) -> tuple[str, str]:
        table, path = f"{kind}_{uuid.uuid4().hex}", fresh_path(self.spark, kind)
        keys = self._KEYS[kind]
        rows.write.format("parquet").bucketBy(self.buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
        return table, path

    def upsert(self, batch: DataFrame) -> None:
        """Add a batch as one run. Equal identifiers of a batch meet map-side first, so a hot one moves once per task."""
        self.columns = batch.columns if self.columns is None else self.columns
        kinds = {f.name: f.dataType for f in batch.schema.fields}
        whole = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if _has_map(kinds[c]) else F.col(f"`{c}`") for c in self.columns])
        item = F.struct(*[F.col(f"`{c}`") for c in self.columns])
        rank = F.struct(
            *[x for i, c in enumerate(self.order) for x in (F.col(f"`{c}`").isNull().alias(f"n{i}"), F.col(f"`{c}`").alias(f"v{i}"))],
            F.col("delivery").alias("h"),
        )
        # Rows without identifier are keyed by their whole content: only equal ones meet.
        own = F.concat(F.lit("row "), F.sha2(F.to_json("item"), 256))
        rows = batch.select("*", whole.alias("delivery")).select(self.key.alias("identifier"), item.alias("item"), rank.alias("rank"), "delivery")
        rows = rows.withColumn("store_key", F.when(F.col("identifier").isNotNull(), F.concat(F.lit("id "), "identifier")).otherwise(own))
        best = rows.groupBy("store_key").agg(F.min_by(F.struct("identifier", "item"), "rank").alias("message"), F.min("rank").alias("rank"))
        told = rows.groupBy("store_key", "delivery").agg(F.count("*").alias("n"))
        self._planned(lambda: self.runs["messages"].append(self._write("messages", best)))
        self._planned(lambda: self.runs["deliveries"].append(self._write("deliveries", told)))

    def merged(self, kind: str, one: str, two: str) -> DataFrame:
        """Two runs as one: the better of two messages, the larger of two counts."""
        keys = self._KEYS[kind]
        a, b = self.spark.table(one).alias("a"), self.spark.table(two).hint("merge").alias("b")
        both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer")
        key = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys]
        if kind == "deliveries":
            return both.select(*key, F.greatest("a.n", "b.n").alias("n"))
        first = F.col("b.rank").isNull() | (F.col("a.rank") <= F.col("b.rank"))
        return both.select(*key, *[F.when(first, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("message", "rank")])

    def compact(self) -> None:
        """Merge the runs pair by pair until one is left of each kind; each merged run is written before its two go."""
        for kind, runs in self.runs.items():
            while len(runs) > 1:
                one, two = runs[0], runs[1]
                runs.append(self._planned(lambda: self._write(kind, self.merged(kind, one[0], two[0]))))  # noqa: B023
                for run in (one, two):
                    runs.remove(run)
                    self._forget(run, files=True)

    def compacted(self) -> DataFrame:
        """identifier, copies (deliveries), item of every message, from the compacted store's files."""
        if self.columns is None:
            raise ValueError("nothing was upserted")
        self.compact()
        best, told = (self.spark.read.schema(self.spark.table(t).schema).parquet(path) for t, path in (self.runs[k][0] for k in ("messages", "deliveries")))
        rows = best.join(told.groupBy("store_key").agg(F.sum("n").alias("copies")), "store_key")
        own = F.col("message.identifier").isNull()
        times = F.when(own, F.col("copies")).otherwise(F.lit(1))
        rows = rows.select(F.col("message.identifier").alias("identifier"), F.when(own, 1).otherwise(F.col("copies")).cast("long").alias("copies"), "message.item", times.alias("times"))
        return rows.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("again", "times")

    def _forget(self, run: tuple[str, str], files: bool) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        if files:
            drop_path(self.spark, run[1])

    def close(self) -> None:
        """Take the store out of the catalogue; files stay readable until the end of the process or scratch() block."""
        for runs in self.runs.values():
            for run in runs:
                self._forget(run, files=False)

    def drop(self) -> None:
        for runs in self.runs.values():
            while runs:
                self._forget(runs.pop(), files=True)


REPLY_ORDER = ["replied_at", "topic_name", "topic_partition", "msg_offset"]


def reply_store(replies: DataFrame, runs: int = 2) -> MessageStore:
    """Embedding replies in a store, upserted in `runs` groups of delivery batches, as a stream would bring them."""
    store = MessageStore(replies.sparkSession, message_identifier(F.col("correlation_id"), F.col("msg_key"), F.col("headers")), REPLY_ORDER)
    for k in range(runs):
        store.upsert(replies.filter(F.pmod(F.xxhash64("batch_id"), F.lit(runs)) == k))
    return store


def _kept(replies: DataFrame) -> DataFrame:
    store = reply_store(replies)
    kept = store.compacted()
    store.close()
    return kept


def deduplicated_replies(replies: DataFrame) -> DataFrame:
    """Exactly one row per identifier (earliest reply, then topic, partition, offset) and every row without one.

    All input columns, then message_id and copies (numbered names where the input has such columns). Null headers, keys and
    bodies count as no identifier; an empty table gives an empty result.
    """
    kept = _kept(replies)
    name_id, name_n = (fresh_name(x, replies.columns) for x in ("message_id", "copies"))
    return kept.select("item.*", F.col("identifier").alias(name_id), F.col("copies").alias(name_n))


def repeated_identifiers(replies: DataFrame) -> DataFrame:
    """Identifiers that more than one row carries, with the number of rows."""
    kept = _kept(replies).filter(F.col("identifier").isNotNull() & (F.col("copies") > 1))
    return kept.select(F.col("identifier").alias("correlation_id"), "copies")
