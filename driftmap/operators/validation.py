"""Validation of events, and a profile of a data set in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FLAGS, HEADING_MAX, LAT_MAX, LON_MAX, NANO, div, flag

ERROR, WARNING, INFO = "error", "warning", "info"
OPTIONAL = ("correlation_id", "altitude_mm", "velocity_mms", "heading_cdeg", "accuracy_mm", "ttl_seconds", "group_id", "user_data")
SHORT = ("correlation_id", "altitude", "velocity", "heading", "accuracy", "ttl", "group_id", "user_data")


@dataclass(frozen=True)
class Options:
    """Checks to make. Time from 2000 to 2100, expiry up to 30 days."""

    coordinates: bool = True
    timestamps: bool = True
    entity_ids: bool = True
    required: bool = True
    heading: bool = True
    ttl: bool = True
    reserved: bool = True
    flags: bool = True
    ordering: bool = False
    uniqueness: bool = False
    max_ttl: int = 30 * 86_400
    min_ts: int = 946_684_800 * NANO
    max_ts: int = 4_102_444_800 * NANO


def _issue(category: str, severity: str, name: str) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(name).alias("field"))


def validate(events: DataFrame, options: Options = Options(), arrival: str = "event_id") -> DataFrame:
    """All columns, ``issues`` (array of category, severity, field) and ``is_valid``.

    Only errors make an event invalid. The checks on order and uniqueness look at an
    entity's earlier arrivals. Columns ``id_ts_ns`` (the time within the composite id) and
    ``reserved`` take part where the events have them.
    """
    e, o = F.col, options
    found: list[tuple[Column, Column]] = []
    if o.coordinates:
        found += [(F.abs(e(c)) > most, _issue("coordinate_range", ERROR, c)) for c, most in (("lat_nano", LAT_MAX), ("lon_nano", LON_MAX))]
    if o.timestamps:
        none, t = e("ts_ns") == 0, "timestamp_invalid"
        found.append((none, _issue(t, ERROR, "timestamp")))
        found.append((~none & (e("ts_ns") < o.min_ts), _issue(t, WARNING, "timestamp")))
        found.append((~none & (e("ts_ns") > o.max_ts), _issue(t, WARNING, "timestamp")))
        if "id_ts_ns" in events.columns:
            found.append((~none & (e("id_ts_ns") != e("ts_ns")), _issue(t, ERROR, "id")))
    if o.ordering:
        w = Window.partitionBy("entity_id").orderBy(arrival)
        events = events.withColumn("_last", F.lag("ts_ns").over(w))
        found.append(((e("entity_id") != 0) & (e("ts_ns") < e("_last")), _issue("timestamp_ordering", WARNING, "timestamp")))
    if o.entity_ids:
        found.append((e("entity_id") == 0, _issue("entity_id_format", ERROR, "entity_id")))
    if o.uniqueness:
        w = Window.partitionBy("entity_id", "ts_ns").orderBy(arrival)
        events = events.withColumn("_copy", F.row_number().over(w))
        found.append(((e("entity_id") != 0) & (e("_copy") > 1), _issue("entity_id_duplicate", WARNING, "entity_id")))
    if o.required:
        found.append((e("event_id") == 0, _issue("required_field", ERROR, "id")))
    if o.heading:
        found.append((e("heading_cdeg") > HEADING_MAX, _issue("heading_range", ERROR, "heading_cdeg")))
    if o.ttl:
        found.append((e("ttl_seconds") > o.max_ttl, _issue("ttl_exceeded", WARNING, "ttl_seconds")))
    if o.reserved and "reserved" in events.columns:
        found.append((e("reserved") != 0, _issue("reserved_field", WARNING, "reserved")))
    if o.flags:
        found.append((F.shiftright("flags", len(FLAGS)) != 0, _issue("flag_invalid", WARNING, "flags.padding")))
        found.append((flag("deleted") & flag("linked"), _issue("business_rule", INFO, "flags")))
    listed = events.withColumn("issues", F.array_compact(F.array(*[F.when(c, i) for c, i in found])))
    valid = ~F.exists("issues", lambda x: x["severity"] == ERROR)
    return listed.withColumn("is_valid", valid).drop("_last", "_copy")


def result_json() -> Column:
    """A validated event's result as a JSON document, from ``issues`` and ``is_valid``."""
    one = lambda x: F.struct(
        x["category"].alias("category"), x["severity"].alias("severity"), x["field"].alias("field"),
        F.concat(F.regexp_replace(x["category"], "_", " "), F.lit(": "), x["field"]).alias("message"),
    )
    return F.to_json(F.struct("is_valid", F.size("issues").alias("error_count"), F.transform("issues", one).alias("errors")))


def profile(events: DataFrame, options: Options = Options()) -> DataFrame:
    """One row of counts, bounds and shares; a single aggregate with partial sums.

    Entities are counted through their own partial aggregate, so distinct ids never meet in
    one task.
    """
    checked = validate(events, options)
    cat = lambda c: F.sum(F.size(F.filter("issues", lambda x: x["category"] == c)))
    has = lambda s: F.exists("issues", lambda x: x["severity"] == s)
    sums = checked.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if("is_valid").alias("valid_events"),
        F.count_if(has(WARNING)).alias("warning_events"),
        *[f(c).alias(f"{n}_{c}") for c in ("lat_nano", "lon_nano") for n, f in (("min", F.min), ("max", F.max))],
        F.min(F.when(F.col("ts_ns") != 0, F.col("ts_ns"))).alias("min_ts_ns"),
        F.max("ts_ns").alias("max_ts_ns"),
        F.count_if(F.col("ts_ns") == 0).alias("zero_timestamp_count"),
        F.count_if(F.col("entity_id") == 0).alias("zero_entity_count"),
        *[F.count_if(F.col(c) != 0).alias(f"has_{s}") for c, s in zip(OPTIONAL, SHORT, strict=True)],
        *[F.count_if(flag(n)).alias(f"{n}_count") for n in FLAGS],
        *[
            F.coalesce(cat(c), F.lit(0)).alias(n)
            for n, c in (
                ("coord_errors", "coordinate_range"), ("timestamp_errors", "timestamp_invalid"), ("entity_id_errors", "entity_id_format"),
                ("required_field_errors", "required_field"), ("heading_errors", "heading_range"), ("ttl_errors", "ttl_exceeded"), ("flag_errors", "flag_invalid"),
            )
        ],
    )
    named = events.filter("entity_id <> 0").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    both = sums.withColumns(
        {"unique_entity_count": named.agg(F.count(F.lit(1))).scalar(), "duplicate_entity_count": named.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()}
    )
    filled = sum((F.col(f"has_{s}") for s in SHORT), F.lit(0))
    return both.withColumns(
        {
            "invalid_events": F.col("total_events") - F.col("valid_events"),
            "completeness_percent": F.round(F.when(F.col("total_events") > 0, filled * 100.0 / (8 * F.col("total_events"))).otherwise(0.0), 6),
            "success_percent": F.round(F.when(F.col("total_events") > 0, F.col("valid_events") * 100.0 / F.col("total_events")).otherwise(100.0), 6),
            "span_seconds": div(F.col("max_ts_ns"), NANO) - div(F.col("min_ts_ns"), NANO),
        }
    )
