"""Expiries that come due together: a histogram of the next day, and its peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import NANO, div

HOURS, THRESHOLD = 24, 3.0  # fixed values


def histogram(state: DataFrame, as_of_ns: int, hours: int = HOURS) -> DataFrame:
    """(bucket, n): rows to expire in each hour ahead; the last takes all that is later."""
    due = F.col("ts_ns") + F.col("ttl_seconds") * NANO
    ahead = state.filter((F.col("ttl_seconds") > 0) & (due > as_of_ns))
    bucket = F.least(div(due - as_of_ns, 3_600 * NANO), F.lit(hours - 1)).cast("long")
    return ahead.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def cliffs(state: DataFrame, as_of_ns: int, threshold: float = THRESHOLD, hours: int = HOURS) -> DataFrame:
    """(bucket, n, severity): hours with more than ``threshold`` times the mean of all hours."""
    found = histogram(state, as_of_ns, hours)  # at most ``hours`` rows
    mean = found.agg(F.sum("n") / F.lit(float(hours))).scalar()
    both = found.withColumn("severity", F.round(F.col("n") / mean, 6))
    return both.filter(F.col("severity") > threshold).select("bucket", "n", "severity")
