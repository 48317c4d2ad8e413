"""Last-write-wins: the latest position of every entity, and what of it is live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ttl import is_expired
from ..model import flag
from .windows import running


def order_of(df: DataFrame) -> list[Column]:
    """Newest first; of equal times the larger cell, then the larger event."""
    names = [c for c in ("cell_key", "event_id") if c in df.columns]
    return [F.col("ts_ns").desc(), *[F.col(c).desc() for c in names]]


def latest(events: DataFrame) -> DataFrame:
    """One row per entity: its newest event.

    ``row_number() = 1`` plans a group limit on both sides of the exchange, so a task sends
    one row per entity it has seen, and an entity with a third of all events does not skew it.
    """
    w = Window.partitionBy("entity_id").orderBy(*order_of(events))
    return events.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def replay(state: DataFrame, events: DataFrame, arrival: str = "event_id") -> DataFrame:
    """The state after events in order of arrival: one row per entity, none for a deleted one.

    An event newer than what its entity holds takes its place, and any event revives an
    entity that holds nothing; a tombstone newer than what is held removes it. Between two
    tombstones only the newest event counts, so events are first reduced to one row for each
    entity and number of tombstones before it; a task then walks along an entity's tombstones.
    However a sequence is cut into batches, the state is the same.
    """
    columns = state.columns
    key = lambda s: F.struct(s["ts_ns"], s["event_id"])
    dead = flag("deleted")
    row = F.struct(*columns)
    own = events.withColumn("seq", F.col(arrival).cast("long")).withColumn("_row", row)
    own = running(own.withColumn("_dead", dead), ["entity_id"], "_epoch", F.when(dead, 1).otherwise(0), F.sum)
    runs = own.groupBy("entity_id", "_epoch").agg(
        F.max_by(F.when(~F.col("_dead"), F.col("_row")), F.when(~F.col("_dead"), F.struct("ts_ns", "event_id"))).alias("_live"),
        F.max(F.when(F.col("_dead"), F.struct("ts_ns", "event_id"))).alias("_end"),
    )
    held = state.filter(~dead).select("entity_id", F.lit(-1).cast("long").alias("_epoch"), row.alias("_live"), F.lit(None).cast(runs.schema["_end"].dataType).alias("_end"))
    walked = runs.unionByName(held).groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("_epoch", "_live", "_end"))).alias("_runs"))
    nothing = F.lit(None).cast(held.schema["_live"].dataType)

    def step(now, run):
        newer = F.when(now.isNull() | (key(run["_live"]) > key(now)), F.coalesce(run["_live"], now)).otherwise(now)
        return F.when(newer.isNotNull() & run["_end"].isNotNull() & (run["_end"] > key(newer)), nothing).otherwise(newer)

    return walked.select(F.aggregate("_runs", nothing, step).alias("_row")).filter("_row IS NOT NULL").select("_row.*")


def live(state: DataFrame, as_of_ns: int, mode: str = "read") -> DataFrame:
    """Rows of a latest state that are neither deleted nor expired."""
    return state.filter(~flag("deleted") & ~is_expired(as_of_ns, mode))


def scatter_merge(parts: list[DataFrame], limit: int) -> DataFrame:
    """Answers of several stores as one: the newest of each entity, newest first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return latest(out).orderBy(*order_of(out), "entity_id").limit(limit)


def status(state: DataFrame, as_of_ns: int) -> DataFrame:
    """Counters of a state: entities, tombstones, live and expired, and the tombstones' share."""
    dead, late = flag("deleted"), is_expired(as_of_ns)
    return state.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~dead).alias("entities"),
        F.count_if(dead).alias("tombstones"),
        F.count_if(~dead & late).alias("expired"),
        F.count_if(~dead & ~late).alias("live"),
        F.round(F.count_if(dead) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("tombstone_ratio"),
    )
