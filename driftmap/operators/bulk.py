"""Filtered bulk export: time, place, entities, groups, and where to resume."""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ttl import is_expired
from ..model import NANO, flag


@dataclass(frozen=True)
class ExportFilter:
    """Time [start, end), box in degrees with its bounds, lists, and what is left out."""

    start_ns: int = 0
    end_ns: int = 2**63 - 1
    box: tuple[float, float, float, float] = (-90.0, 90.0, -180.0, 180.0)  # south, north, west, east
    entities: Sequence[int] = ()
    groups: Sequence[int] = ()
    include_deleted: bool = False
    include_expired: bool = False
    after_event: int | None = None


def day_range(year: int, month: int, day: int) -> tuple[int, int]:
    """A UTC day as [start, end) in nanoseconds."""
    start = calendar.timegm((year, month, day, 0, 0, 0)) * NANO
    return start, start + 86_400 * NANO


def select(events: DataFrame, what: ExportFilter, as_of_ns: int) -> DataFrame:
    """The events to export; all bounds are plain comparisons, so Parquet can prune by them."""
    south, north, west, east = (round(x * NANO) for x in what.box)
    out = events.filter((F.col("ts_ns") >= what.start_ns) & (F.col("ts_ns") < what.end_ns))
    out = out.filter(F.col("lat_nano").between(south, north) & F.col("lon_nano").between(west, east))
    if what.entities:
        out = out.filter(F.col("entity_id").isin(*what.entities))
    if what.groups:
        out = out.filter(F.col("group_id").isin(*what.groups))
    if what.after_event is not None:
        out = out.filter(F.col("event_id") > what.after_event)
    if not what.include_deleted:
        out = out.filter(~flag("deleted"))
    return out if what.include_expired else out.filter(~is_expired(as_of_ns, "cleanup"))


def of_entities(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Events of a long list of entities (entity_id), by a semi-join."""
    return events.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")


def summary(selected: DataFrame) -> DataFrame:
    """What an export holds, and the event after which to resume."""
    return selected.agg(
        F.count(F.lit(1)).alias("exported"), F.max("event_id").alias("last_event_id"), F.min("ts_ns").alias("min_ts_ns"), F.max("ts_ns").alias("max_ts_ns")
    )
