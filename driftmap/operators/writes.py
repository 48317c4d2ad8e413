"""Writes as DataFrame functions: result codes, and the state that follows.

A batch is a DataFrame of events with ``seq`` (its order of arrival) and ``op`` (``upsert``
or ``delete``). Whether an event is accepted depends on what came before it: it must be newer
than everything its entity has had since the entity was last deleted. That is a running
maximum per entity and deletion epoch, so a batch is decided at once, without a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import s2
from ..functions import ttl as expiry
from ..functions.text import event_key_hex
from ..model import EVENT_SCHEMA, HEADING_MAX, LAT_MAX, LON_MAX, NANO, TTL_MAX, DeleteCode, InsertCode, TtlCode, flag, reserved_ids
from .latest import latest, live
from .windows import BLOCK, running


def event_code(schema: T.StructType = EVENT_SCHEMA) -> Column:
    """Result code of an event by itself; the first check that fails decides.

    A column ``reserved``, a number or bytes, must be zero where the events have it.
    """
    e = F.col
    zero, most = reserved_ids(schema["entity_id"].dataType)
    cases = [
        (e("entity_id") == zero, InsertCode.ENTITY_ID_ZERO),
        (e("entity_id") == most, InsertCode.ENTITY_ID_MAX),
        (F.abs(e("lat_nano")) > LAT_MAX, InsertCode.INVALID_COORDINATES_LAT),
        (F.abs(e("lon_nano")) > LON_MAX, InsertCode.INVALID_COORDINATES_LON),
        (e("heading_cdeg") > HEADING_MAX, InsertCode.HEADING_OUT_OF_RANGE),
    ]
    if "reserved" in schema.fieldNames():
        used = F.hex("reserved").rlike("[^0]") if isinstance(schema["reserved"].dataType, T.BinaryType) else e("reserved") != 0
        cases.append((F.coalesce(used, F.lit(False)), InsertCode.RESERVED_FIELD))
    out = F.lit(int(InsertCode.OK))
    for when, code in reversed(cases):
        out = F.when(when, int(code)).otherwise(out)
    return out


def stamped(batch: DataFrame, commit_ns: int, default_ttl: int = 0) -> DataFrame:
    """Times and expiry filled in: an event without a time gets one of the batch's own.

    Row i of n gets commit_ns - n + 1 + i, where i is its ``seq`` counted from 0.
    """
    own = F.lit(commit_ns) - batch.agg(F.count(F.lit(1))).scalar() + 1 + F.col("seq")
    return batch.withColumns(
        {
            "ts_ns": F.when(F.col("ts_ns") == 0, own).otherwise(F.col("ts_ns")),
            "ttl_seconds": F.when(F.col("ttl_seconds") == 0, default_ttl).otherwise(F.col("ttl_seconds")),
        }
    )


def decide(state: DataFrame, batch: DataFrame, block: int = BLOCK) -> DataFrame:
    """The batch with ``code``, ``epoch`` (deletions of the entity before the row) and ``accepted``.

    ``state`` holds one row per entity; tombstones in it count as absent, so any event
    revives a deleted entity, even an older one.
    """
    cell = F.col("cell_key") if "cell_key" in batch.columns else F.lit(0).cast("long")
    own = batch.withColumn("_cell", cell).withColumn("_own", F.when(F.col("op") == "upsert", event_code(batch.schema)).otherwise(0))
    old_cell = F.col("cell_key") if "cell_key" in state.columns else F.lit(0).cast("long")
    touched = batch.select("entity_id").distinct()
    old = state.filter(~flag("deleted")).join(touched, "entity_id", "left_semi")
    old = old.select("entity_id", "ts_ns", F.lit(-1).cast("long").alias("seq"), F.lit("state").alias("op"), old_cell.alias("_cell"), F.lit(0).alias("_own"))
    rows = own.unionByName(old, allowMissingColumns=True)
    rows = running(rows, ["entity_id"], "epoch", F.when(F.col("op") == "delete", 1).otherwise(0), F.sum, block)
    good = (F.col("op") != "delete") & (F.col("_own") == 0)
    rows = running(rows, ["entity_id", "epoch"], "_top", F.when(good, F.struct("ts_ns", "_cell")), F.max, block)
    newer = F.col("_top").isNull() | (F.struct("ts_ns", "_cell") > F.col("_top"))
    upsert = F.when(F.col("_own") != 0, F.col("_own")).when(newer, int(InsertCode.OK)).otherwise(int(InsertCode.EXISTS))
    zero, most = reserved_ids(batch.schema["entity_id"].dataType)
    delete = (
        F.when(F.col("entity_id") == zero, int(DeleteCode.ENTITY_ID_ZERO))
        .when(F.col("entity_id") == most, int(DeleteCode.ENTITY_ID_MAX))
        .when(F.col("_top").isNotNull(), int(DeleteCode.OK))
        .otherwise(int(DeleteCode.NOT_FOUND))
    )
    rows = rows.filter("op <> 'state'").withColumn("code", F.when(F.col("op") == "delete", delete).otherwise(upsert))
    return rows.withColumn("accepted", F.col("code") == 0).drop("_cell", "_own", "_top")


def apply(state: DataFrame, decided: DataFrame, commit_ns: int) -> DataFrame:
    """The state after a decided batch: the last accepted write of each entity, else what was.

    A deletion leaves a tombstone: the deleted flag, no expiry, the time of its commit.
    """
    w = Window.partitionBy("entity_id").orderBy(F.col("seq").desc())
    last = decided.filter("accepted").withColumn("_rank", F.row_number().over(w)).filter("_rank = 1")
    gone = F.col("op") == "delete"
    sized = F.lit(commit_ns) + F.col("seq")
    values = {c: F.col(c) for c in state.columns}
    values["flags"] = F.when(gone, F.coalesce("flags", F.lit(0)).bitwiseOR(F.lit(32))).otherwise(F.col("flags"))
    values["ttl_seconds"] = F.when(gone, 0).otherwise(F.col("ttl_seconds"))
    values["ts_ns"] = F.when(gone, sized).otherwise(F.col("ts_ns"))
    fresh = last.select(*[v.cast(state.schema[c].dataType).alias(c) for c, v in values.items()])
    sides = [df.select("entity_id", F.struct(*state.columns).alias(n)) for df, n in ((state, "_old"), (fresh, "_new"))]
    return sides[0].join(sides[1], "entity_id", "full").select(F.coalesce("_new", "_old").alias("_row")).select("_row.*")


def assigned(batch: DataFrame) -> DataFrame:
    """Events with the cell of their place and, where ids are text, the id that cell and time make.

    An id that a client sends is not taken. Integer ids cannot hold the composite; they stay.
    """
    out = batch.withColumn("cell_key", s2.cell_key(F.col("lat_nano"), F.col("lon_nano")))
    if isinstance(batch.schema["event_id"].dataType, T.StringType):
        out = out.withColumn("event_id", event_key_hex(F.col("cell_key"), F.col("ts_ns")))
    return out


def insert_events(state: DataFrame, batch: DataFrame, commit_ns: int, default_ttl: int = 0) -> tuple[DataFrame, DataFrame]:
    """Codes (seq, entity_id, code) of a batch of events, and the state that follows.

    A state with ``cell_key`` has its events' cells, and text ids, assigned on the way.
    """
    rows = stamped(batch.withColumn("op", F.lit("upsert")), commit_ns, default_ttl)
    decided = decide(state, assigned(rows) if "cell_key" in state.columns else rows)
    return decided.select("seq", "entity_id", "code"), apply(state, decided, commit_ns)


upsert_events = insert_events


def delete_entities(state: DataFrame, ids: DataFrame, commit_ns: int) -> tuple[DataFrame, DataFrame]:
    """Codes of ids (seq, entity_id), and the state with tombstones; a second mention is not found."""
    batch = ids.select("seq", F.col("entity_id").cast(state.schema["entity_id"].dataType), F.lit("delete").alias("op"))
    for f in state.schema:
        if f.name not in batch.columns:
            batch = batch.withColumn(f.name, F.lit(None).cast(f.dataType))
    decided = decide(state, batch)
    return decided.select("seq", "entity_id", "code"), apply(state, decided, commit_ns)


def change_ttl(state: DataFrame, requests: DataFrame, how: str) -> DataFrame:
    """(entity_id, code, previous_ttl, new_ttl) of requests (entity_id, seconds).

    ``how``: ``set`` to, ``extend`` by, or ``clear``. Only the expiry changes: neither the
    event's time nor its place takes part.
    """
    old = state.filter(~flag("deleted")).select("entity_id", F.col("ttl_seconds").alias("previous_ttl"))
    asked = requests.join(old, "entity_id", "left")
    longer = F.least(F.col("previous_ttl") + F.col("seconds"), F.lit(TTL_MAX))
    new = {"set": F.col("seconds"), "extend": longer, "clear": F.lit(0)}[how]
    found = F.col("previous_ttl").isNotNull()
    return asked.select(
        "entity_id",
        F.when(found, int(TtlCode.OK)).otherwise(int(TtlCode.NOT_FOUND)).alias("code"),
        "previous_ttl",
        F.when(found, new).cast("long").alias("new_ttl"),
    )


def with_ttl(state: DataFrame, changed: DataFrame) -> DataFrame:
    """The state with the expiries of ``change_ttl`` in place."""
    new = changed.filter("code = 0").select("entity_id", "new_ttl")
    return state.join(new, "entity_id", "left").withColumn("ttl_seconds", F.coalesce("new_ttl", "ttl_seconds")).select(*state.columns)


def cleanup_expired(state: DataFrame, as_of_ns: int, batch_size: int = 0) -> tuple[DataFrame, DataFrame]:
    """(entries_scanned, entries_removed) and the state without what has expired.

    ``batch_size`` bounds the scan by order of entity; 0 scans all.
    """
    late = expiry.is_expired(as_of_ns, "cleanup")
    if not batch_size:
        return state.agg(F.count(F.lit(1)).alias("entries_scanned"), F.count_if(late).alias("entries_removed")), state.filter(~late)
    part = state.orderBy("entity_id").limit(batch_size)
    counted = part.agg(F.count(F.lit(1)).alias("entries_scanned"), F.count_if(late).alias("entries_removed"))
    return counted, state.join(part.filter(late).select("entity_id"), "entity_id", "left_anti")


def compact(events: DataFrame, as_of_ns: int) -> DataFrame:
    """What a compaction keeps of a log: the newest row of each entity, unless deleted or expired."""
    return live(latest(events), as_of_ns, "cleanup")


def layout(events: DataFrame, path: str, files: int, key: str = "cell_key") -> None:
    """Write events in ranges of a key, sorted, so that row-group statistics prune by place."""
    events.repartitionByRange(files, key).sortWithinPartitions(key, "ts_ns").write.parquet(path)


def commit_time(batch_number: int) -> int:
    """A commit time in nanoseconds from a batch's number, for replays without a clock."""
    return batch_number * NANO
