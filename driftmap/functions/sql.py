"""SQL functions for use in raw SQL. They expand inline, so filters on them still reach scans."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..model import FLAGS, NANO
from .geo import haversine_sql

FUNCTIONS = {
    "st_distance_mm(lat1 BIGINT, lon1 BIGINT, lat2 BIGINT, lon2 BIGINT) RETURNS DOUBLE": haversine_sql("lat1", "lon1", "lat2", "lon2"),
    "st_within_radius(lat BIGINT, lon BIGINT, lat0 BIGINT, lon0 BIGINT, radius_mm BIGINT) RETURNS BOOLEAN": (
        "lat BETWEEN lat0 - CAST(ceil(radius_mm / 111.19D * 1000) + 10 AS BIGINT) AND lat0 + CAST(ceil(radius_mm / 111.19D * 1000) + 10 AS BIGINT) AND "
        f"floor({haversine_sql('lat0', 'lon0', 'lat', 'lon')}) <= radius_mm"
    ),
    "ttl_expired(ts_ns BIGINT, ttl_seconds BIGINT, now_ns BIGINT) RETURNS BOOLEAN": f"ttl_seconds > 0 AND now_ns div {NANO} > ts_ns div {NANO} + ttl_seconds",
    "event_flag(flags BIGINT, name STRING) RETURNS BOOLEAN": "CASE name " + " ".join(f"WHEN '{n}' THEN (flags & {1 << b}) <> 0" for n, b in FLAGS.items()) + " END",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
