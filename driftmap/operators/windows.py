"""Running aggregates in two levels, for keys that may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def running(df: DataFrame, keys: list[str], name: str, value: Column, agg: Callable, block: int = BLOCK) -> DataFrame:
    """Adds ``name``: ``agg`` of ``value`` over the rows of a key before this one, by ``seq``.

    Two levels: within blocks of ``seq``, and over whole blocks. A key with a third of all
    rows is then spread over its blocks; only a row per block meets in one task.
    """
    rows = df.withColumn("_block", F.floor(F.col("seq") / F.lit(block))).withColumn("_value", value)
    inner = Window.partitionBy(*keys, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(agg("_value").alias("_total")).withColumn("_before", agg("_total").over(outer))
    joined = rows.withColumn("_inner", agg("_value").over(inner)).join(totals.drop("_total"), [*keys, "_block"], "left")
    both = F.array_compact(F.array("_inner", "_before"))
    combined = F.array_max(both) if agg is F.max else F.coalesce("_inner", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return joined.withColumn(name, combined).drop("_block", "_value", "_inner", "_before")
