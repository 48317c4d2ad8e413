"""Row transforms of the ETL pipeline, as columns.

A pipeline is a list of steps. Each says whether a row may pass; what happens to one that
may not depends on the step and the pipeline: dropped, counted as failed, or kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import COORDINATE_TRANSFORMS
from ..model import FLAGS, HEADING_MAX, LAT_MAX, LON_MAX

# Unit conversion factors.
UNIT_FACTORS = {
    "meters_to_feet": 3.28084,
    "feet_to_meters": 0.3048,
    "mps_to_kmh": 3.6,
    "kmh_to_mps": 1.0 / 3.6,
    "mps_to_mph": 2.23694,
    "mph_to_mps": 0.44704,
    "km_to_miles": None,  # declared, without effect on any field
    "miles_to_km": None,
}
LENGTHS, SPEEDS = ("altitude_mm", "accuracy_mm"), ("velocity_mms",)
#: Field names of steps: column, and what divides it into the unit of filters.
FIELDS = {
    "latitude": ("lat_nano", 1e9), "longitude": ("lon_nano", 1e9), "altitude": ("altitude_mm", 1000.0), "velocity": ("velocity_mms", 1000.0),
    "accuracy": ("accuracy_mm", 1000.0), "heading": ("heading_cdeg", 100.0), "timestamp": ("ts_ns", 1.0),
}


def truncated(value: Column) -> Column:
    """A double cut towards zero."""
    return value.cast("long")


def convert_units(df: DataFrame, conversion: str, target: str = "all") -> DataFrame:
    factor = UNIT_FACTORS[conversion]
    if factor is None:
        return df
    columns = LENGTHS if conversion in ("meters_to_feet", "feet_to_meters") else SPEEDS
    own = [c for c in columns if target == "all" or FIELDS[target][0] == c]
    return df.withColumns({c: truncated(F.col(c).cast("double") * F.lit(factor)) for c in own})


def convert_coordinates(df: DataFrame, how: str) -> DataFrame:
    """Between coordinate systems; the projections to and from web maps leave rows as they are."""
    if how in ("wgs84_to_web_mercator", "web_mercator_to_wgs84"):
        return df
    lat, lon = COORDINATE_TRANSFORMS[how](F.col("lat_nano") / F.lit(1e9), F.col("lon_nano") / F.lit(1e9))
    return df.withColumns({"lat_nano": truncated(lat * 1e9), "lon_nano": truncated(lon * 1e9)})


def predicate(target: str, op: str, value: float = 0.0, value2: float = 0.0) -> Column:
    """A filter on a field in degrees, metres or metres a second."""
    name, unit = FIELDS[target]
    x = F.col(name).cast("double") / F.lit(unit)
    return {
        "eq": x == value, "ne": x != value, "gt": x > value, "gte": x >= value, "lt": x < value, "lte": x <= value,
        "in_range": x.between(value, value2), "out_range": ~x.between(value, value2), "is_null": x == 0, "is_not_null": x != 0,
    }[op]


def fill_default(df: DataFrame, target: str, value: int) -> DataFrame:
    """A value, in raw units, where altitude, velocity, accuracy or heading is 0."""
    name = FIELDS[target][0]
    if target not in ("altitude", "velocity", "accuracy", "heading"):
        return df
    return df.withColumn(name, F.when(F.col(name) == 0, F.lit(value).cast("long")).otherwise(F.col(name)))


def clamp(df: DataFrame, target: str, low: float, high: float) -> DataFrame:
    """Bounds in degrees for coordinates, raw for altitude; velocity only from above; heading wraps."""
    name, _ = FIELDS[target]
    x = F.col(name)
    if target in ("latitude", "longitude"):
        y = truncated(F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x / F.lit(1e9))) * 1e9)
    elif target == "altitude":
        y = F.greatest(F.lit(int(low)), F.least(F.lit(int(high)), x))
    elif target == "velocity":
        y = F.least(F.lit(int(high)), x)
    elif target == "heading":
        y = F.when(x > HEADING_MAX, x % (HEADING_MAX + 1)).otherwise(x)
    else:
        return df
    return df.withColumn(name, y.cast("long"))


def compute(df: DataFrame, target: str, op: str, operand: float = 0.0) -> DataFrame:
    """Arithmetic on altitude, velocity or time; a negative velocity or time is not taken."""
    if target not in ("altitude", "velocity", "timestamp"):
        return df
    name = FIELDS[target][0]
    x = F.col(name).cast("double")
    half_away = F.signum(x) * F.floor(F.abs(x) + 0.5)
    y = {
        "add": x + operand, "subtract": x - operand, "multiply": x * operand, "divide": x / operand if operand else x,
        "round": half_away, "floor": F.floor(x), "ceiling": F.ceil(x), "abs": F.abs(x), "negate": -x,
    }[op]
    new = truncated(y)
    return df.withColumn(name, new if target == "altitude" else F.when(y >= 0, new).otherwise(F.col(name)))


def shift_time(df: DataFrame, by_ns: int) -> DataFrame:
    """Later or earlier; a time that would fall below 0 stays."""
    moved = F.col("ts_ns") + F.lit(by_ns)
    return df.withColumn("ts_ns", F.when(moved >= 0, moved).otherwise(F.col("ts_ns")))


def set_flag(df: DataFrame, name: str, value: bool) -> DataFrame:
    if name == "none":
        return df
    bit = 1 << FLAGS[name]
    f = F.col("flags")
    return df.withColumn("flags", f.bitwiseOR(F.lit(bit)) if value else f.bitwiseAND(F.lit(~bit)))


@dataclass(frozen=True)
class Step:
    """One transform: ``kind`` names the function above, ``args`` are its arguments."""

    kind: str
    args: tuple = ()
    skip_on_failure: bool = False


@dataclass(frozen=True)
class Pipeline:
    steps: tuple[Step, ...] = ()
    continue_on_error: bool = True
    check_coordinates: bool = False

    def mark(self, df: DataFrame) -> DataFrame:
        """Rows transformed, with ``outcome``: succeeded, filtered or failed.

        A row that a step has dropped or failed is not changed by later steps.
        """
        out = df.withColumn("outcome", F.lit("succeeded"))
        apply = {
            "units": convert_units, "coordinates": convert_coordinates, "default": fill_default, "clamp": clamp,
            "math": compute, "shift": shift_time, "flag": set_flag,
        }
        for step in self.steps:
            on = F.col("outcome") == "succeeded"
            if step.kind == "filter":
                verdict = "filtered" if step.skip_on_failure else None if self.continue_on_error else "failed"
                if verdict:
                    out = out.withColumn("outcome", F.when(on & ~predicate(*step.args), verdict).otherwise(F.col("outcome")))
                continue
            done = apply[step.kind](out, *step.args)
            touched = [c for c in df.columns if c in ("lat_nano", "lon_nano", "altitude_mm", "velocity_mms", "accuracy_mm", "heading_cdeg", "ts_ns", "flags")]
            kept = done.select(*[F.col(c) for c in done.columns])
            if any(s.kind == "filter" for s in self.steps):
                before = [F.col(c).alias(f"_{c}") for c in touched]
                wide = out.select("*", *before)
                wide = apply[step.kind](wide, *step.args)
                kept = wide.withColumns({c: F.when(on, F.col(c)).otherwise(F.col(f"_{c}")) for c in touched}).drop(*[f"_{c}" for c in touched])
            out = kept
        if self.check_coordinates:
            bad = (F.abs("lat_nano") > LAT_MAX) | (F.abs("lon_nano") > LON_MAX)
            out = out.withColumn("outcome", F.when((F.col("outcome") == "succeeded") & bad, "failed").otherwise(F.col("outcome")))
        return out

    def run(self, df: DataFrame) -> DataFrame:
        """The rows that came through."""
        return self.mark(df).filter("outcome = 'succeeded'").drop("outcome")

    def statistics(self, df: DataFrame) -> DataFrame:
        """Counts of a batch: total, succeeded, failed, filtered."""
        return self.mark(df).agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("outcome") == x).alias(x) for x in ("succeeded", "failed", "filtered")],
        )


