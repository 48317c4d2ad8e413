"""Where events belong: nearest region, shards, tiers, and conflicts between regions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..model import NANO

Region = tuple[int, int, int]  # id, latitude, longitude in nanodegrees

# --- regions ---------------------------------------------------------------------------


def nearest_region(events: DataFrame, regions: list[Region], healthy: set[int] | None = None) -> DataFrame:
    """Adds ``region_id`` and ``region_m``: the nearest of a few regions, the first of equals.

    Regions are literals of the query: no join.
    """
    use = [r for r in regions if healthy is None or r[0] in healthy]
    if not use:
        return events.withColumns({"region_id": F.lit(None).cast("int"), "region_m": F.lit(None).cast("long")})
    far = [geo.haversine_mm(F.col("lat_nano"), F.col("lon_nano"), F.lit(la), F.lit(lo)) for _, la, lo in use]
    options = [F.struct(d.alias("d"), F.lit(i).alias("i"), F.lit(r[0]).alias("id")) for i, (d, r) in enumerate(zip(far, use, strict=True))]
    best = events.withColumn("_best", F.array_min(F.array(*options)))
    return best.withColumns({"region_id": F.col("_best.id"), "region_m": F.round(F.col("_best.d") / 1000).cast("long")}).drop("_best")


def route(events: DataFrame, strategy: str, regions: list[Region], explicit: dict[int, int] | None = None, prefix_bits: int = 8, default: int = 0) -> DataFrame:
    """``region_id`` by strategy: none, nearest, id_prefix or explicit."""
    if strategy == "nearest":
        return nearest_region(events, regions).drop("region_m")
    if strategy == "id_prefix":
        at = F.shiftrightunsigned("entity_id", 64 - prefix_bits) % max(1, len(regions))
        ids = F.array(*[F.lit(r[0]) for r in regions])
        return events.withColumn("region_id", F.element_at(ids, at.cast("int") + 1))
    if strategy == "explicit":
        kind = events.schema["entity_id"].dataType.simpleString()
        table = events.sparkSession.createDataFrame(list((explicit or {}).items()), f"entity_id {kind}, _region int")
        joined = events.join(table, "entity_id", "left")  # Spark broadcasts the table while it is small
        return joined.withColumn("region_id", F.coalesce("_region", F.lit(default))).select(*events.columns, "region_id")
    if strategy == "none":
        return events.withColumn("region_id", F.lit(default))
    raise ValueError(f"no such strategy: {strategy}")


# --- shards ----------------------------------------------------------------------------

VNODES = 150
# The published constants of the finaliser and of jump hashing.
FINALISER = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
JUMP_STEP = 2862933555777941757


def finalise(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    for c in FINALISER:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(c)
    return x ^ (x >> np.uint64(33))


def shard_keys(low: np.ndarray, high: np.ndarray | None = None) -> np.ndarray:
    """Shard keys of 128-bit ids, given as halves."""
    low = np.asarray(low).astype(np.uint64)
    return finalise(low) ^ finalise(np.zeros_like(low) if high is None else np.asarray(high).astype(np.uint64))


def jump(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Jump consistent hash, over whole arrays; a key leaves the loop when it has landed."""
    k = np.asarray(keys, np.uint64).copy()
    b, j = np.full(len(k), -1, np.int64), np.zeros(len(k), np.int64)
    step = np.uint64(JUMP_STEP)
    while (go := j < buckets).any():
        b[go] = j[go]
        k[go] = k[go] * step + np.uint64(1)
        j[go] = ((b[go] + 1) * (float(1 << 31) / ((k[go] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
    return b


def ring(shards: int, vnodes: int = VNODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of a hash ring and the shard of each."""
    shard, node = np.repeat(np.arange(shards, dtype=np.uint64), vnodes), np.tile(np.arange(vnodes, dtype=np.uint64), shards)
    at = shard_keys(node, shard)
    order = np.argsort(at, kind="stable")
    return at[order], shard[order].astype(np.int64)


def shards_of(ids: np.ndarray, shards: int, strategy: str, high: np.ndarray | None = None) -> np.ndarray:
    """The shards of ids, given as their low and, for 128 bits, high halves."""
    keys = shard_keys(ids, high)
    if strategy == "modulo":
        return (keys & np.uint64(shards - 1)).astype(np.int64)
    if strategy == "jump":
        return jump(keys, shards)
    if strategy == "ring":
        positions, owner = ring(shards)
        return owner[np.searchsorted(positions, keys, side="left") % len(positions)]
    if strategy == "spatial":  # ids are cells
        return jump(np.asarray(ids).astype(np.uint64) >> np.uint64(32), shards)
    raise ValueError(f"no such strategy: {strategy}")


def shard(entity: Column, shards: int, strategy: str = "jump") -> Column:
    """The shard of an id, exact; wrapping arithmetic needs numpy, hence an Arrow function."""
    if strategy == "modulo" and shards & (shards - 1):
        raise ValueError("modulo shards are a power of two")

    def run(col: pa.Array) -> pa.Array:
        none = col.is_null().to_numpy(zero_copy_only=False)
        if pa.types.is_string(col.type):  # 32 hex digits
            halves = np.frombuffer(bytes.fromhex("".join(col.fill_null("0" * 32).to_pylist())), ">u8").reshape(-1, 2).astype(np.uint64)
            return pa.array(shards_of(halves[:, 1], shards, strategy, halves[:, 0]), mask=none)
        return pa.array(shards_of(col.fill_null(0).to_numpy(zero_copy_only=False), shards, strategy), mask=none)

    return F.arrow_udf(run, "bigint")(entity)


def covering_shards(ranges: tuple[tuple[int, int], ...], shards: int) -> list[int]:
    """Shards, by spatial key, that the leaf ranges of a covering can touch; all if it is wide."""
    keys: list[np.ndarray] = []
    for low, high in ranges:
        first, last = low >> 32, (high - 1) >> 32
        if last - first > 1 << 16:
            return list(range(shards))
        keys.append(np.arange(first, last + 1, dtype=np.uint64))
    return sorted(set(jump(np.concatenate(keys), shards).tolist())) if keys else []


def shard_statistics(events: DataFrame, shards: int, strategy: str = "jump") -> DataFrame:
    """Rows a shard: mean, deviation and the largest over the mean. Entities are placed once."""
    sizes = events.groupBy("entity_id").count().withColumn("shard", shard(F.col("entity_id"), shards, strategy)).groupBy("shard").agg(F.sum("count").alias("n"))
    every = events.sparkSession.range(shards).withColumnRenamed("id", "shard").join(F.broadcast(sizes), "shard", "left").fillna(0, ["n"])
    return every.agg(
        F.sum("n").alias("total"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("deviation"), F.round(F.max("n") / F.avg("n"), 6).alias("imbalance")
    )


def moved(events: DataFrame, before: int, after: int, strategy: str = "jump") -> DataFrame:
    """A resharding plan: entities and rows by shard before and after."""
    return _placed(events, before, after, strategy).groupBy("source", "target").agg(F.count(F.lit(1)).alias("entities"), F.sum("n_rows").alias("n_rows"))


def _placed(events: DataFrame, before: int, after: int, strategy: str) -> DataFrame:
    own = events.groupBy("entity_id").count()
    own = own.withColumns({"source": shard(F.col("entity_id"), before, strategy), "target": shard(F.col("entity_id"), after, strategy)})
    return own.filter("source <> target").withColumnRenamed("count", "n_rows")


def migration_batches(events: DataFrame, before: int, after: int, batch_entities: int = 1000, strategy: str = "jump") -> DataFrame:
    """(entity_id, source, target, n_rows, batch): what moves, in batches of about ``batch_entities``.

    A batch goes from one shard to one other. Entities are dealt by hash over as many batches
    as the pair of shards needs, so no pair is numbered in one task.
    """
    moving = _placed(events, before, after, strategy)
    pairs = moving.groupBy("source", "target").agg(F.ceil(F.count(F.lit(1)) / batch_entities).alias("_batches"))  # at most before x after rows
    dealt = moving.join(F.broadcast(pairs), ["source", "target"])
    return dealt.select("entity_id", "source", "target", "n_rows", F.pmod(F.xxhash64("entity_id"), F.col("_batches")).alias("batch"))


# --- tiers -----------------------------------------------------------------------------


@dataclass(frozen=True)
class TierRules:
    """Idle times and access counts between hot, warm and cold."""

    hot_idle_ns: int = 3_600 * NANO
    warm_idle_ns: int = 86_400 * NANO
    warm_after: int = 3
    hot_after: int = 10
    window_ns: int = 3_600 * NANO
    max_hot: int = 0
    max_warm: int = 0


class _Replay:
    """One entity's accesses, in order; the first of them is its insertion, which makes it hot."""

    def __init__(self, rules: TierRules, now: int) -> None:
        self.rules, self.tier, self.start, self.count, self.last, self.ups = rules, "hot", now, 1, now, 0

    def age(self, now: int) -> None:
        if self.tier == "hot" and now - self.last >= self.rules.hot_idle_ns:
            self.tier = "warm"
        if self.tier == "warm" and now - self.last >= self.rules.warm_idle_ns:
            self.tier, self.start = "cold", None

    def access(self, now: int) -> None:
        self.age(now)
        if self.start is None or now - self.start > self.rules.window_ns:  # a cold entity is not tracked
            self.start, self.count = now, 0
        self.count, self.last = self.count + 1, now
        need = {"cold": self.rules.warm_after, "warm": self.rules.hot_after}.get(self.tier)
        if need is not None and self.count >= need:
            self.tier, self.ups, self.count = ("warm" if self.tier == "cold" else "hot"), self.ups + 1, 0


def _tier_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ["entity_id", "tier", "last_access_ns", "promotions"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def tiers(accesses: DataFrame, as_of_ns: int, rules: TierRules = TierRules()) -> DataFrame:
    """(entity_id, tier, last_access_ns, promotions) after an access log (entity_id, ts_ns).

    An entity is hot from its first row on, goes down a tier for every idle time that passes
    (as if a clock ticked all the time), and up when accesses within a window are enough.
    Accesses come sorted by entity and time and are replayed as they pass by, so that a task
    holds the state of one entity, never its log.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows = None, None, []

        def close() -> None:
            if state is not None:
                state.age(as_of_ns)
                rows.append((now, state.tier, state.last, state.ups))

        for batch in batches:
            for entity, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or entity != now:
                    close()
                    now, state = entity, _Replay(rules, t)
                else:
                    state.access(t)
            if len(rows) > 10_000:
                yield _tier_rows(rows)
                rows.clear()
        close()
        if rows:
            yield _tier_rows(rows)

    ordered = accesses.select("entity_id", "ts_ns").repartition("entity_id").sortWithinPartitions("entity_id", "ts_ns")
    out = ordered.mapInArrow(run, "entity_id bigint, tier string, last_access_ns bigint, promotions bigint")
    for name, below, most in (("hot", "warm", rules.max_hot), ("warm", "cold", rules.max_warm)):
        if most:  # the least recently used of a full tier go one down
            keep = out.filter(F.col("tier") == name).orderBy(F.col("last_access_ns").desc(), "entity_id").limit(most).select("entity_id", F.lit(True).alias("_keep"))
            out = out.join(keep, "entity_id", "left").withColumn("tier", F.when((F.col("tier") == name) & F.col("_keep").isNull(), below).otherwise(F.col("tier"))).drop("_keep")
    return out


# --- vector clocks ---------------------------------------------------------------------


def compare_clocks(ours: Column, theirs: Column) -> Column:
    """less_than, greater_than, equal or concurrent, for clocks as maps of region to time."""
    pairs = F.map_values(F.map_zip_with(ours, theirs, lambda _, a, b: F.struct(F.coalesce(a, F.lit(0)).alias("a"), F.coalesce(b, F.lit(0)).alias("b"))))
    less, more = F.exists(pairs, lambda p: p["a"] < p["b"]), F.exists(pairs, lambda p: p["a"] > p["b"])
    return F.when(less & more, "concurrent").when(less, "less_than").when(more, "greater_than").otherwise("equal")


def merge_clocks(ours: Column, theirs: Column) -> Column:
    return F.map_zip_with(ours, theirs, lambda _, a, b: F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))))


def resolve(df: DataFrame, policy: str = "last_writer_wins", primary: int = 0) -> DataFrame:
    """Adds ``comparison`` and ``winner`` to rows (local_clock, remote_clock, local_ns, remote_ns, remote_region).

    A clock that is behind loses; concurrent ones are settled by time or by primary region.
    """
    out = df.withColumn("comparison", compare_clocks(F.col("local_clock"), F.col("remote_clock")))
    remote = F.col("remote_ns") > F.col("local_ns") if policy == "last_writer_wins" else F.col("remote_region") == primary
    if policy not in ("last_writer_wins", "primary_wins"):
        raise ValueError(f"no such policy: {policy}")
    settled = F.when(remote, "remote").otherwise("local")
    return out.withColumn("winner", F.when(F.col("comparison") == "concurrent", settled).when(F.col("comparison") == "less_than", "remote").otherwise("local"))
