"""Incremental load: what a source adds to and changes in a target, and how conflicts end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARED = ("ts_ns", "lat_nano", "lon_nano", "altitude_mm", "velocity_mms", "heading_cdeg", "accuracy_mm", "flags", "ttl_seconds", "correlation_id", "group_id", "user_data")
MERGED = ("correlation_id", "altitude_mm", "velocity_mms", "heading_cdeg", "accuracy_mm", "ttl_seconds", "group_id", "user_data")
POLICIES = ("source_wins", "target_wins", "latest_wins", "merge_source_priority", "merge_target_priority", "reject")


def _side(df: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(c) for c in df.columns]).alias(name)


def _merged(df: DataFrame, ours: str, theirs: str) -> Column:
    fields = []
    for c in df.columns:
        a, b = F.col(f"{ours}.{c}"), F.col(f"{theirs}.{c}")
        x = F.coalesce(F.nullif(a, F.lit(0)), b) if c in MERGED else F.greatest(a, b) if c == "ts_ns" else a
        fields.append(x.alias(c))
    return F.struct(*fields)


def changes(source: DataFrame, target: DataFrame, last_sync_ns: int = 0, policy: str = "latest_wins", arrival: str = "event_id") -> DataFrame:
    """(operation, entity_id, ts_ns, had_conflict, event, previous) of every source row that counts.

    Rows before the last sync are passed over. An entity that the target does not have is an
    insert; one that differs is an update, or a conflict if both sides changed since the last
    sync. A conflict that the policy leaves open has the operation ``conflict`` and no event.
    Of several target rows of an entity the last to arrive counts; nothing is ever deleted.
    """
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    w = Window.partitionBy("entity_id").orderBy(F.col(arrival).desc())
    last = target.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").select(F.col("entity_id").alias("_entity"), _side(target, "t"))
    rows = source.filter(F.col("ts_ns") >= last_sync_ns).select(_side(source, "s"))
    both = rows.join(last, F.col("s.entity_id") == F.col("_entity"), "left")
    fresh = F.col("_entity").isNull()
    differs = F.lit(False)
    for c in COMPARED:
        differs = differs | ~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    conflict = ~fresh & (F.col("t.ts_ns") > last_sync_ns) & (F.col("s.ts_ns") > last_sync_ns)
    resolved = {
        "source_wins": F.col("s"),
        "target_wins": F.col("t"),
        "latest_wins": F.when(F.col("s.ts_ns") >= F.col("t.ts_ns"), F.col("s")).otherwise(F.col("t")),
        "merge_source_priority": _merged(source, "s", "t"),
        "merge_target_priority": _merged(source, "t", "s"),
        "reject": F.lit(None).cast(rows.schema["s"].dataType),
    }[policy]
    operation = F.when(fresh, "insert").when(conflict & F.lit(policy == "reject"), "conflict").otherwise("update")
    return both.filter(fresh | differs).select(
        operation.alias("operation"),
        F.col("s.entity_id").alias("entity_id"),
        F.col("s.ts_ns").alias("ts_ns"),
        F.coalesce(conflict, F.lit(False)).alias("had_conflict"),
        F.when(conflict, resolved).otherwise(F.col("s")).alias("event"),
        F.when(~fresh, F.col("t")).alias("previous"),
    )


def load(target: DataFrame, changed: DataFrame) -> DataFrame:
    """The target with a change set applied: the last change of an entity, by time, stands."""
    w = Window.partitionBy("entity_id").orderBy(F.col("ts_ns").desc(), F.col("event.event_id").desc())
    last = changed.filter("event IS NOT NULL").withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").select("event.*")
    return target.join(last.select("entity_id"), "entity_id", "left_anti").unionByName(last.select(*target.columns))


def statistics(changed: DataFrame, source: DataFrame) -> DataFrame:
    """Counts of a load and its checkpoint: the newest time that it has seen."""
    counts = changed.agg(
        *[F.count_if(F.col("operation") == x).alias(f"{x}s") for x in ("insert", "update", "conflict")],
        F.count_if("had_conflict").alias("had_conflict"),
    )
    return counts.withColumns({"source_events": source.agg(F.count(F.lit(1))).scalar(), "checkpoint_ns": source.agg(F.max("ts_ns")).scalar()})
