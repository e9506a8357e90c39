"""Session set-up and the shared place for intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "corpusloom", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and bench.py; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, in local mode only, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


#: Folders that this process made in the shared one and still has to delete; each scratch() block has its own list.
_MADE: list[list[tuple[SparkSession, str]]] = [[]]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder. It is deleted at the end of the innermost scratch() block, else of this process."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if len(_MADE) == 1 and not _MADE[0]:
        atexit.register(_sweep, _MADE[0])  # runs before the session's own exit
    _MADE[-1].append((spark, path))
    return path


def _sweep(made: list[tuple[SparkSession, str]]) -> None:
    while made:
        spark, path = made.pop()
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone, and its folder with it
            continue


@contextmanager
def scratch():
    """Everything that is written to the shared folder inside the block is deleted at its end; read results before."""
    _MADE.append([])
    try:
        yield
    finally:
        _sweep(_MADE.pop())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a parquet table in the shared folder: cuts the lineage, survives lost executors, is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(name: str, taken) -> str:
    """name, or name with the first number that makes it differ from all taken ones (case is ignored, as in Spark)."""
    low, k, new = {x.lower() for x in taken}, 0, name
    while new.lower() in low:
        k += 1
        new = f"{name}_{k}"
    return new


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    if spark.sparkContext.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    own = tempfile.mkdtemp(prefix="corpusloom-zip-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    made = shutil.make_archive(os.path.join(own, "corpusloom_package"), "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(made)
    _SHIPPED.add(spark.sparkContext.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if a plain scan of few files gives fewer; large inputs, and plans that shuffle or
    join, stay as they are. For work that takes far longer than moving its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "AdaptiveSparkPlan" in plan.executedPlan().toString() or df.isStreaming:
        return df
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df
