"""Collections of points on parquet: definition, upserts, deletes, counts.

A collection is a folder of runs. An upsert appends a run of rows, a delete a run of tombstones; readers keep the row of the latest
run of each id, so writes cost what they bring and compaction rewrites the rest when it pays.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.vectors import DISTANCES
from corpusloom.operators.filters import Filter, filter_column
from corpusloom.session import drop_path


#: What failures say that may pass: fixed values.
TRANSIENT = ("deadline exceeded", "connection refused", "connection reset", "temporarily unavailable", "timed out")


@dataclass(frozen=True)
class VectorConfig:
    name: str
    size: int
    distance: str = "cosine"


@dataclass(frozen=True)
class CollectionSchema:
    """Named vectors (a nameless one is text_dense, the last of a name counts) and storage hints."""

    name: str
    vectors: list[VectorConfig] = field(default_factory=list)
    shards: int = 1
    replication_factor: int = 1
    on_disk_payload: bool = True
    optimizers_memmap: bool = True

    def checked(self) -> CollectionSchema:
        if not self.name.strip():
            raise ValueError("a collection needs a name")
        if not self.vectors:
            raise ValueError("a collection needs a vector")
        named = {v.name.strip() or "text_dense": VectorConfig(v.name.strip() or "text_dense", v.size, v.distance) for v in self.vectors}
        for v in named.values():
            if v.size < 1:
                raise ValueError(f"vector {v.name} needs a size")
            if v.distance not in DISTANCES:
                raise ValueError(f"distance must be one of {DISTANCES}, not {v.distance!r}")
        return CollectionSchema(self.name.strip(), list(named.values()), max(1, self.shards), max(1, self.replication_factor), self.on_disk_payload, self.optimizers_memmap)


class Collections:
    """Collections below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str, *parts: str) -> str:
        if "/" in name or name in ("", ".", ".."):
            raise ValueError(f"{name!r} is no collection's name")
        return "/".join([self.root, name, *parts])

    def exists(self, name: str, attempts: int = 3, wait_ms: int = 300) -> bool:
        """Whether there is such a collection. A file system that doesn't answer is asked again, after a wait that doubles."""
        at = self._path(self._at(name, "_schema"))
        for k in range(1, attempts + 1):
            try:
                return self._fs.exists(at)
            except Py4JJavaError as e:
                if k == attempts or not any(x in str(e.java_exception).lower() for x in TRANSIENT):
                    raise
                time.sleep(wait_ms / 1000 * 2 ** (k - 1))
        return False

    def schema(self, name: str) -> CollectionSchema:
        if not self.exists(name):
            raise LookupError(f"there is no collection {name!r}")
        raw = json.loads(self.spark.read.text(self._at(name, "_schema")).first()[0])
        return CollectionSchema(**raw | {"vectors": [VectorConfig(**v) for v in raw["vectors"]]})

    def create(self, schema: CollectionSchema) -> None:
        schema = schema.checked()
        if self.exists(schema.name):
            raise ValueError(f"collection {schema.name!r} exists")
        self.spark.createDataFrame([(json.dumps(asdict(schema)),)], "value string").coalesce(1).write.text(self._at(schema.name, "_schema"))

    def ensure(self, schema: CollectionSchema) -> None:
        """Create it unless it exists; one with other vectors is an error."""
        schema = schema.checked()
        if not self.exists(schema.name):
            self.create(schema)
        elif {v.name: v for v in self.schema(schema.name).vectors} != {v.name: v for v in schema.vectors}:
            raise ValueError(f"collection {schema.name!r} has other vectors")

    def drop(self, name: str) -> None:
        drop_path(self.spark, self._at(name))

    def _runs(self, name: str) -> list[int]:
        at = self._path(self._at(name))
        found = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(x[4:]) for x in found if x.startswith("run=") and x[4:].isdigit())

    def _append(self, name: str, rows: DataFrame) -> None:
        tmp = self._at(name, f"_writing-{uuid.uuid4().hex}")
        rows.write.parquet(tmp)
        # The run's number is taken by making its marker, which only one writer can; then the run moves to a name that is its alone.
        run = (self._runs(name) or [0])[-1] + 1
        while not self._fs.createNewFile(self._path(self._at(name, f"_taken-{run}"))):
            run += 1
        if not self._fs.rename(self._path(tmp), self._path(self._at(name, f"run={run}"))):
            raise RuntimeError(f"run {run} could not be put in place; write again")

    def upsert(self, name: str, points: DataFrame) -> None:
        """Rows with an id (string) and at least one vector or searchable text. Of equal ids in a batch the last by all columns counts.
        Vectors must have the collection's length."""
        schema = self.schema(name)
        if "id" not in points.columns:
            raise ValueError("points need an id")
        for v in schema.vectors:
            if v.name in points.columns:
                wrong = F.col(v.name).isNotNull() & (F.size(v.name) != v.size)
                message = F.concat(F.lit(f"{v.name} must have {v.size} items, not "), F.size(v.name).cast("string"))
                points = points.withColumn(v.name, F.when(wrong, F.raise_error(message).cast(points.schema[v.name].dataType)).otherwise(F.col(v.name)))
        item = F.struct(*[c for c in points.columns if c != "id"])
        one = points.filter(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), item.alias("item"), F.xxhash64(F.to_json(item)).alias("h"))
        one = one.groupBy("id").agg(F.max_by("item", "h").alias("item"))
        self._append(name, one.select("id", "item", F.lit(False).alias("gone")).repartition(schema.shards, "id") if schema.shards > 1 else one.select("id", "item", F.lit(False).alias("gone")))

    def insert(self, name: str, points: DataFrame, deterministic: bool = True) -> None:
        """Rows without ids get one: from document and chunk number, so that a repeated ingest overwrites, or a random one."""
        new = F.xxhash64("doc_id", "chunk_index").cast("string") if deterministic else F.uuid()
        self.upsert(name, points.withColumn("id", new))

    def rows(self, name: str, among: tuple[str, DataFrame] | None = None) -> DataFrame:
        """The live rows. among: a column and its wanted values (one column); then only rows that have, or had, one of them are merged."""
        self.schema(name)
        if not self._runs(name):
            return self.spark.createDataFrame([], T.StructType([T.StructField("id", T.StringType())]))
        runs = self._runs(name)
        if len(runs) == 1:  # ids are unique within a run
            live = self.spark.read.parquet(self._at(name, f"run={runs[0]}")).filter(~F.col("gone")).select("id", "item.*")
            return live.join(among[1].toDF(among[0]), among[0], "left_semi") if among else live
        every = self.spark.read.option("basePath", self._at(name)).option("mergeSchema", "true").parquet(*[self._at(name, f"run={k}") for k in runs])
        if among:
            wanted = among[1].toDF("__value")
            ids = every.select("id", F.col(f"item.{among[0]}").alias("__value")).join(wanted, "__value", "left_semi").select("id").distinct()
            every = every.join(ids, "id", "left_semi")
        latest = every.groupBy("id").agg(F.max_by(F.struct("item", "gone"), "run").alias("x"))
        live = latest.filter(~F.col("x.gone")).select("id", "x.item.*")
        return live.join(among[1].toDF(among[0]), among[0], "left_semi") if among else live

    def _tombs(self, name: str, ids: DataFrame) -> None:
        first = self.spark.read.parquet(self._at(name, f"run={self._runs(name)[0]}")).schema["item"].dataType
        self._append(name, ids.select("id", F.lit(None).cast(first).alias("item"), F.lit(True).alias("gone")))

    def delete_where(self, name: str, f: Filter) -> None:
        if f is None or f.empty:
            raise ValueError("a delete needs a filter")
        rows = self.rows(name)
        if self._runs(name):
            self._tombs(name, rows.filter(filter_column(f, rows.schema)).select("id"))

    def delete_ids(self, name: str, ids: DataFrame) -> None:
        """ids: one column id. Whole numbers and their decimal text are the same id."""
        self.schema(name)
        if self._runs(name):
            self._tombs(name, ids.select(F.col("id").cast("string").alias("id")).filter("id IS NOT NULL").distinct())

    def count(self, name: str, f: Filter | None = None) -> int:
        rows = self.rows(name)
        keep = filter_column(f, rows.schema)
        return (rows if keep is None else rows.filter(keep)).count()

    def compact(self, name: str) -> None:
        """All runs as one; the old ones go when the new one stands."""
        old = self._runs(name)
        if len(old) > 1:
            rows = self.rows(name)
            self._append(name, rows.select("id", F.struct(*[c for c in rows.columns if c != "id"]).alias("item"), F.lit(False).alias("gone")))
            for k in old:
                drop_path(self.spark, self._at(name, f"run={k}"))
