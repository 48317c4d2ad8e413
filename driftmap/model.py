"""The event model: schema, units, flags, result codes, and test data derived from ``events``."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NANO = 1_000_000_000
LAT_MAX, LON_MAX = 90 * NANO, 180 * NANO
HEADING_MAX = 36_000
TTL_MAX = 2**32 - 1
EARTH_RADIUS_MM = 6_371_000_000

# Bit positions of the flags.
FLAGS = {"linked": 0, "imported": 1, "stationary": 2, "low_accuracy": 3, "offline": 4, "deleted": 5}


class InsertCode(IntEnum):
    """Result codes of event writes."""

    OK = 0
    RESERVED_FIELD = 4
    ENTITY_ID_ZERO = 7
    INVALID_COORDINATES_LAT = 9
    INVALID_COORDINATES_LON = 10
    EXISTS = 13
    HEADING_OUT_OF_RANGE = 14
    ENTITY_ID_MAX = 16


class DeleteCode(IntEnum):
    """Result codes of entity deletions."""

    OK = 0
    ENTITY_ID_ZERO = 2
    NOT_FOUND = 3
    ENTITY_ID_MAX = 4


class TtlCode(IntEnum):
    """Result codes of expiry changes."""

    OK = 0
    NOT_FOUND = 1


class QueryStatus(IntEnum):
    """Status of a query and of its input."""

    OK = 0
    INVALID = 1
    POLYGON_TOO_COMPLEX = 101
    POLYGON_SELF_INTERSECTING = 109
    POLYGON_TOO_LARGE = 111
    POLYGON_DEGENERATE = 112
    TOO_MANY_HOLES = 117
    HOLE_VERTEX_COUNT = 118
    HOLE_NOT_CONTAINED = 119
    HOLES_OVERLAP = 120
    ENTITY_NOT_FOUND = 200
    ENTITY_EXPIRED = 210


#: The largest entity id of test data; stands for the reserved all-ones id.
ENTITY_ID_MAX = 2**63 - 1


def reserved_ids(kind: T.DataType) -> tuple[int | str, int | str]:
    """The reserved ids, all zeros and all ones: integers, or 32 hex digits for 128-bit ids as text."""
    return ("0" * 32, "f" * 32) if isinstance(kind, T.StringType) else (0, ENTITY_ID_MAX)


EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("entity_id", T.LongType()),
        T.StructField("correlation_id", T.LongType()),
        T.StructField("user_data", T.LongType()),
        T.StructField("ts_ns", T.LongType()),
        T.StructField("lat_nano", T.LongType()),
        T.StructField("lon_nano", T.LongType()),
        T.StructField("group_id", T.LongType()),
        T.StructField("altitude_mm", T.LongType()),
        T.StructField("velocity_mms", T.LongType()),
        T.StructField("accuracy_mm", T.LongType()),
        T.StructField("heading_cdeg", T.LongType()),
        T.StructField("ttl_seconds", T.LongType()),
        T.StructField("flags", T.LongType()),
    ]
)
COLUMNS = EVENT_SCHEMA.fieldNames()
IDS = ("event_id", "entity_id", "correlation_id", "user_data")
#: Events whose ids have 128 bits, as 32 lower-case hex digits.
WIDE_SCHEMA = T.StructType([T.StructField(f.name, T.StringType() if f.name in IDS else f.dataType) for f in EVENT_SCHEMA])


def flag(name: str) -> Column:
    """Whether an event has a flag."""
    return F.shiftright(F.col("flags"), FLAGS[name]).bitwiseAND(F.lit(1)) == 1


def div(value: Column, by: int | Column) -> Column:
    """Integer division; a double would lose the last digits of nanoseconds."""
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by))


def to_nano(degrees: float) -> int:
    """Degrees to nanodegrees, rounded as the client library does."""
    return round(degrees * NANO)


#: The projection from ``events``; the same text runs in Spark and, for ``ts``, DuckDB's ``epoch_us``.
_PROJECTION = """
  event_id, user_id AS entity_id,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id * 11 END AS correlation_id,
  (event_id % 4) * 17 AS user_data,
  {micros} * 1000 AS ts_ns,
  40000000000 + ((event_id * 7919 + user_id * 104729) % 2000003) * 1000 - 1000000000 AS lat_nano,
  -74000000000 + ((event_id * 15485863 + user_id * 1299709) % 2000003) * 1000 - 1000000000 AS lon_nano,
  user_id % 8 AS group_id,
  (event_id * 31) % 200001 - 50000 AS altitude_mm,
  (event_id * 37) % 40000 AS velocity_mms,
  (event_id * 13) % 20000 AS accuracy_mm,
  (event_id * 101) % 36500 AS heading_cdeg,
  (event_id % 5) * 86400 AS ttl_seconds,
  (event_id * 7) % 32 + CASE WHEN event_id % 97 = 0 THEN 32 ELSE 0 END AS flags
"""
EVENTS_SQL = "SELECT " + _PROJECTION.format(micros="epoch_us(ts)") + " FROM events"


def geo_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location events derived from the ``events`` table with integer arithmetic only."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")
    text = _PROJECTION.format(micros="unix_micros(CAST(ts AS TIMESTAMP))")
    parts, depth, at = [], 0, 0
    for i, ch in enumerate(text):  # split at commas outside parentheses
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(text[at:i])
            at = i + 1
    return raw.selectExpr(*[p.strip() for p in [*parts, text[at:]]])
