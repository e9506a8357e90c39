"""Vectorised helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of which two long columns are sent to every executor at most; larger sets are joined by a shuffle.
BROADCAST_ROWS = 500_000


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (the finaliser of splitmix64, fixed public constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf32(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def binary_column(rows: np.ndarray) -> pa.Array:
    """One binary value per row of a 2-d uint8 array."""
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def attach(pairs: DataFrame, table: DataFrame, key: str, value: str, n_pairs: int, unique: bool = True) -> DataFrame:
    """pairs (a, b, ...) with value_a and value_b from table. pairs is a written table of n_pairs rows. A key that is not unique gets
    its least value, after the rows that no pair asks for are gone.

    Few pairs: their keys go to the table's rows, so the table is scanned and only matching rows move. Many: a shuffle join.
    """
    keys = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    if n_pairs <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    used = table.select(key, value).join(keys, key, "left_semi")
    if not unique:
        used = used.groupBy(key).agg(F.min(value).alias(value))
    for side in ("a", "b"):
        own = used.select(F.col(key).alias(side), F.col(value).alias(f"{value}_{side}"))
        pairs = pairs.join(own, side)
    return pairs


def ranked(df: DataFrame, by: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
