"""Live positions: the newest event of every entity, kept as state, with expiry as a timer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import EVENT_SCHEMA, NANO, div
from ..operators.latest import replay
from ..state import keep

OUTPUT = T.StructType([*EVENT_SCHEMA.fields, T.StructField("change", T.StringType())])
FIELDS = EVENT_SCHEMA.fieldNames()
TS, TTL, FLAGS_AT = (FIELDS.index(c) for c in ("ts_ns", "ttl_seconds", "flags"))
BUCKETS = 64


def _plain(row) -> tuple:
    return tuple(None if pd.isna(x) else int(x) for x in row)


class LatestPosition(StatefulProcessor):
    """Emits a row whenever an entity's latest position changes or runs out.

    ``change`` is INSERT, UPDATE, DELETE (a tombstone came) or EXPIRE (a timer fired). Events
    count in order of arrival: those not newer than the state change nothing; after a
    tombstone any event counts. A null time never counts, other nulls stay nulls.
    """

    def __init__(self, arrival: str = "event_id") -> None:
        self.arrival = arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("latest", EVENT_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.held.get() if self.held.exists() else None
        now, change, last = old, None, None
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.arrival, kind="stable")  # one entity's part of a micro-batch
        for row in batch[FIELDS].itertuples(index=False, name=None):
            row = _plain(row)
            if row[TS] is None:
                continue
            if now is not None and (row[TS], row[0] or 0) <= (now[TS], now[0] or 0):
                continue
            dead = bool((row[FLAGS_AT] or 0) & 32)
            if dead and now is None:
                continue
            change = "DELETE" if dead else "INSERT" if now is None else "UPDATE"
            now, last = (None if dead else row), row
        if change is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if now is None:
            self.held.clear()
        else:
            self.held.update(now)
            if now[TTL]:
                self.handle.registerTimer((now[TS] + now[TTL] * NANO) // 1_000_000)
        if now is None and old is None:
            return
        if now is not None:
            change = "INSERT" if old is None else "UPDATE"
        yield pd.DataFrame([(*last, change)], columns=[*FIELDS, "change"]).astype({c: "Int64" for c in FIELDS})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            row = _plain(self.held.get())
            self.held.clear()
            yield pd.DataFrame([(*row, "EXPIRE")], columns=[*FIELDS, "change"]).astype({c: "Int64" for c in FIELDS})

    def close(self) -> None:
        pass


def positions(stream: DataFrame, delay: str = "10 minutes", arrival: str = "event_id") -> DataFrame:
    """The change stream of latest positions, by event time; needs the RocksDB state store.

    ``arrival`` names the column by which events of one micro-batch came in.
    """
    timed = stream.withColumn("event_time", F.timestamp_micros(div(F.col("ts_ns"), 1000)))
    return timed.withWatermark("event_time", delay).groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=LatestPosition(arrival), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime"
    )


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """For each bucket, the batch that wrote it last, as batch ``number`` left it."""
    if number < 0:
        return {}
    rows = spark.read.schema("bucket int, version int").parquet(f"{path}/manifest/{number}").collect()  # at most BUCKETS
    return {r["bucket"]: r["version"] for r in rows}


def snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The latest positions that ``merge_batches`` has kept, after its last batch or a given one."""
    if number is None:
        at, fs = _files(spark, f"{path}/manifest")
        done = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = [int(n) for n in done if n.isdigit() and fs.exists(_files(spark, f"{path}/manifest/{n}/_SUCCESS")[0])]
        number = max(done, default=-1)
    return _parts(spark, path, _versions(spark, path, number))


def _parts(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    parts = [f"{path}/bucket={b}/{v}" for b, v in sorted(versions.items())]
    return spark.read.schema(EVENT_SCHEMA).parquet(*parts) if parts else spark.createDataFrame([], EVENT_SCHEMA)


def merge_batches(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, arrival: str = "event_id"):
    """Start a query that keeps a Parquet snapshot of latest positions, micro-batch by micro-batch.

    The snapshot lies in ``BUCKETS`` parts by a hash of the entity. A batch writes anew the
    parts that it touches, under its own number, then a manifest that names each part's
    version; a batch that is run again writes the same. Versions that neither this manifest
    nor the one before it names are removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("entity_id"), F.lit(BUCKETS)).cast("int")
        touched = sorted(r["b"] for r in batch.select(bucket.alias("b")).distinct().collect())  # at most BUCKETS
        before = _versions(spark, path, number - 1)
        old = _parts(spark, path, {b: before[b] for b in touched if b in before})
        rows = batch.select(*FIELDS, F.col(arrival).alias("_arrival"))
        after = keep(replay(old, rows, "_arrival").withColumn("_bucket", bucket))
        for b in touched:
            after.filter(F.col("_bucket") == b).drop("_bucket").coalesce(1).write.mode("overwrite").parquet(f"{path}/bucket={b}/{number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame(list(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number}")
        for b in touched if number > 1 else ():
            stale = _versions(spark, path, number - 2).get(b)
            if stale is not None and stale not in (before.get(b), number):
                at, fs = _files(spark, f"{path}/bucket={b}/{stale}")
                fs.delete(at, True)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def deliver(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a query that hands each micro-batch of a change stream to ``sink``."""
    writer = changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("update")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
