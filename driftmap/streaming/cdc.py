"""Change feed: what two states differ in, as ordered envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import flag
from ..sources.files import event_json
from ..state import keep

_ROW = (1 << 33) - 1  # the bits of a generated id that count the rows of a partition


def changes(before: DataFrame, after: DataFrame, commit_ns: int) -> DataFrame:
    """(commit_ts, change_type, entity_id and the event's columns): INSERT, UPDATE or DELETE.

    Entities whose rows are equal do not appear. A tombstone, or an absent row, is a DELETE
    with the last live event.
    """
    live_before, live_after = before.filter(~flag("deleted")), after.filter(~flag("deleted"))
    a = live_before.select(F.col("entity_id").alias("_id"), F.struct(*before.columns).alias("a"))
    b = live_after.select(F.col("entity_id").alias("_id"), F.struct(*before.columns).alias("b"))
    both = a.join(b, "_id", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    kind = F.when(F.col("a").isNull(), "INSERT").when(F.col("b").isNull(), "DELETE").otherwise("UPDATE")
    return both.select(F.lit(commit_ns).alias("commit_ts"), kind.alias("change_type"), F.coalesce("b", "a").alias("e")).select("commit_ts", "change_type", "e.*")


def numbered(changed: DataFrame, first: int = 0) -> DataFrame:
    """Adds ``sequence``: dense numbers in order of time and entity, without a single sort task.

    Rows are range-partitioned, sorted and numbered within each part, and this is written
    once; the sizes of the written parts, a row each, give where every part begins.
    """
    ranged = changed.repartitionByRange("ts_ns", "entity_id").sortWithinPartitions("ts_ns", "entity_id")
    held = keep(ranged.withColumn("_id", F.monotonically_increasing_id()))
    own = held.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit(_ROW))}).drop("_id")
    sizes = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = own.join(F.broadcast(starts.select("_part", "_start")), "_part")  # a row a partition
    return joined.withColumn("sequence", F.lit(first) + F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def envelopes(changed: DataFrame) -> DataFrame:
    """(sequence, document): a change as JSON, with routing key by kind."""
    text = F.concat(
        F.lit('{"sequence":'), F.col("sequence").cast("string"), F.lit(',"commit_timestamp":'), F.col("commit_ts").cast("string"),
        F.lit(',"change_type":"'), F.col("change_type"), F.lit('","event":'), event_json(), F.lit("}"),
    )
    return changed.select("sequence", F.concat(F.lit("geo.events."), F.lower("change_type")).alias("routing_key"), text.alias("document"))
