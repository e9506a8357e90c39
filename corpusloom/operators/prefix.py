"""Running values over long sequences without one task per sequence.

A window over a whole sequence puts it in one task. Here sequences are cut into blocks of their order number; values run within
blocks, and a second, small window carries them from block to block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def with_block(df: DataFrame, order: str, block: int = BLOCK) -> DataFrame:
    """df with __block: some `block` rows each, cut at quantiles of the order number, so sparse numbers (hashes, times) do as well as dense
    ones. The cuts are one number for every `block` rows."""
    n = df.count()
    if n <= block:
        return df.withColumn("__block", F.lit(0).cast("long"))
    k = -(-n // block)
    found = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / k for i in range(1, k)], 10 * k)).first()[0]
    cuts = np.unique(np.array(found or [], float))

    @F.pandas_udf("long")
    def block_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, x.to_numpy(float, na_value=-np.inf), side="right"))

    return df.withColumn("__block", block_of(F.col(order).cast("double")))


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """df with name = the sum of value over the rows of the same keys up to this one, by order (numbers, unique within keys)."""
    rows = with_block(df, order, block).withColumn("__value", value)
    inner = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__inner", F.sum("__value").over(inner))
    sums = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum"))
    outer = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(outer), F.lit(0))).drop("__sum")
    joined = rows.join(sums, [*keys, "__block"])
    return joined.withColumn(name, F.col("__inner") + F.col("__before")).drop("__block", "__value", "__inner", "__before")


def running_last(df: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """df with name = the last value that is not null among the rows of the same keys up to this one."""
    rows = with_block(df, order, block).withColumn("__value", value)
    inner = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__inner", F.last("__value", ignorenulls=True).over(inner))
    lasts = rows.filter(F.col("__value").isNotNull()).groupBy(*keys, "__block").agg(F.max_by("__value", order).alias("__last"))
    every = rows.select(*keys, "__block").distinct().join(lasts, [*keys, "__block"], "left")
    outer = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("__before", F.last("__last", ignorenulls=True).over(outer)).drop("__last")
    joined = rows.join(every, [*keys, "__block"])
    return joined.withColumn(name, F.coalesce("__inner", "__before")).drop("__block", "__value", "__inner", "__before")


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """df with prev_<column> of the row before in the same keys (null for the first)."""
    rows = with_block(df, order, block)
    inner = Window.partitionBy(*keys, "__block").orderBy(order)
    rows = rows.withColumns({f"prev_{c}": F.lag(c).over(inner) for c in columns}).withColumn("__first", F.row_number().over(inner) == 1)
    ends = rows.groupBy(*keys, "__block").agg(*[F.max_by(c, order).alias(f"__end_{c}") for c in columns])
    outer = Window.partitionBy(*keys).orderBy("__block")
    ends = ends.withColumns({f"__carry_{c}": F.lag(f"__end_{c}").over(outer) for c in columns}).drop(*[f"__end_{c}" for c in columns])
    joined = rows.join(ends, [*keys, "__block"])
    joined = joined.withColumns({f"prev_{c}": F.when(F.col("__first"), F.col(f"__carry_{c}")).otherwise(F.col(f"prev_{c}")) for c in columns})
    return joined.drop("__block", "__first", *[f"__carry_{c}" for c in columns])
