"""Privacy: coordinates made coarser, fields stripped and expiry shortened by purpose."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import div, flag

# Precision levels in order; rounding factor in nanodegrees, accuracy in metres,
# recommended expiry in seconds. The factors are 1000 times finer than their names say; they
# are data, so that a corrected table can be passed instead.
LEVELS = (
    ("precise", 1, 0, 86_400),
    ("meter", 9, 1, 86_400),
    ("street", 90, 10, 604_800),
    ("block", 900, 100, 604_800),
    ("neighborhood", 9_000, 1_000, 2_592_000),
    ("city", 90_000, 10_000, 2_592_000),
    ("region", 900_000, 100_000, 31_536_000),
    ("country", 9_000_000, 1_000_000, 31_536_000),
)
# Purposes in order; precision, stripped fields, longest expiry (0: none),
# whether expiry is enforced, noise in metres, whether consent is needed.
PURPOSES = (
    ("navigation", "meter", (), 3_600, True, 0, True),
    ("fleet_tracking", "street", ("user_data", "correlation_id"), 604_800, True, 0, True),
    ("delivery", "block", ("user_data", "velocity", "heading"), 86_400, True, 0, True),
    ("analytics", "neighborhood", ("user_data", "correlation_id", "velocity", "heading", "accuracy"), 2_592_000, True, 0, True),
    ("emergency", "precise", (), 0, False, 0, False),
    ("marketing", "city", ("user_data", "correlation_id", "velocity", "heading", "altitude", "accuracy"), 86_400, True, 1_000, True),
    ("research", "region", ("user_data", "correlation_id", "velocity", "heading", "altitude", "accuracy"), 31_536_000, True, 5_000, True),
    ("compliance", "region", ("user_data", "correlation_id", "velocity", "heading"), 0, False, 0, False),
)
RANK = {name: i for i, (name, *_) in enumerate(LEVELS)}
ORDER = {name: i for i, (name, *_) in enumerate(PURPOSES)}
CITY = RANK["city"]
NANO_PER_METER = 9
COLUMN = {"velocity": "velocity_mms", "heading": "heading_cdeg", "altitude": "altitude_mm", "accuracy": "accuracy_mm", "user_data": "user_data", "correlation_id": "correlation_id"}


def levels_table(spark: SparkSession, levels: tuple = LEVELS) -> DataFrame:
    """The precision levels as a table of a few rows."""
    return spark.createDataFrame([(i, n, f, a, t) for i, (n, f, a, t) in enumerate(levels)], "level int, name string, factor long, accuracy_m long, ttl long")


def coarser(nano: Column, factor: Column) -> Column:
    """To the nearest multiple, halves away from zero."""
    size = div(F.abs(nano) + div(factor, 2), factor) * factor
    return F.when(nano < 0, -size).otherwise(size).cast("long")


def _pick(level: Column, position: int, levels: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(x[position]).cast("long") for x in levels]), level + 1)


def reduce_precision(df: DataFrame, level: str, levels: tuple = LEVELS) -> DataFrame:
    factor = F.lit(levels[RANK[level]][1]).cast("long")
    return df.withColumns({c: coarser(F.col(c), factor) for c in ("lat_nano", "lon_nano")})


def add_noise(df: DataFrame, radius_m: int, seed: int) -> DataFrame:
    """A uniform angle and a uniform distance, from a seed."""
    angle, far = F.rand(seed) * (2 * math.pi), F.rand(seed + 1) * float(radius_m * NANO_PER_METER)
    moved = df.withColumns({"_a": angle, "_d": far})
    moved = moved.withColumn("lat_nano", F.col("lat_nano") + (F.col("_d") * F.cos("_a")).cast("long"))
    return moved.withColumn("lon_nano", F.col("lon_nano") + (F.col("_d") * F.sin("_a")).cast("long")).drop("_a", "_d")


def minimize(events: DataFrame, purpose: str, settings: DataFrame | None = None, noise_seed: int | None = None, levels: tuple = LEVELS) -> DataFrame:
    """Events as a purpose may see them, with ``precision`` (the level applied).

    ``settings``: (entity_id, allowed_purposes, min_level, is_child), a bit a purpose. An
    entity that does not allow the purpose is anonymised and its events keep nothing but
    place and time; a child's events are no finer than a city. Noise is added only with a seed.
    """
    _, base, strip, most, enforce, noise, _ = PURPOSES[ORDER[purpose]]
    rows = events
    if settings is not None:
        own = settings.select(F.col("entity_id").alias("_id"), "allowed_purposes", "min_level", "is_child")
        rows = rows.join(own, F.col("entity_id") == F.col("_id"), "left")
        allowed = F.coalesce(F.shiftright("allowed_purposes", ORDER[purpose]).bitwiseAND(F.lit(1)) == 1, F.lit(True))
        child = F.coalesce("is_child", F.lit(False))
        level = F.greatest(F.lit(RANK[base]), F.coalesce("min_level", F.lit(0)), F.when(child, CITY).otherwise(0))
    else:
        allowed, child, level = F.lit(True), F.lit(False), F.lit(RANK[base])
    rows = rows.withColumns({"_ok": allowed, "_child": child, "_level": level.cast("int")})
    factor, ok = _pick(F.col("_level"), 1, levels), F.col("_ok")
    out = {c: F.when(ok, coarser(F.col(c), factor)).otherwise(F.col(c)) for c in ("lat_nano", "lon_nano")}
    for name, c in COLUMN.items():
        zero = ~ok | F.lit(name in strip)
        if name in ("user_data", "correlation_id"):
            zero = F.lit(name in strip) | (ok & F.col("_child")) | ~ok
        out[c] = F.when(zero, 0).otherwise(F.col(c))
    out["accuracy_mm"] = F.when(ok, F.greatest(out["accuracy_mm"], _pick(F.col("_level"), 2, levels) * 1000)).otherwise(0)
    out["entity_id"] = F.when(ok, F.col("entity_id")).otherwise(0)
    out["group_id"] = F.when(ok, F.col("group_id")).otherwise(0)
    if enforce:
        rule = _pick(F.col("_level"), 3, levels)
        bound = F.least(rule, F.lit(most)) if most else rule
        over = (F.col("ttl_seconds") == 0) | (F.col("ttl_seconds") > bound)
        out["ttl_seconds"] = F.when(ok & over, bound).otherwise(F.col("ttl_seconds"))
    names = F.element_at(F.array(*[F.lit(x[0]) for x in levels]), F.when(ok, F.col("_level")).otherwise(RANK["country"]) + 1)
    done = rows.withColumns({k: v.cast("long") for k, v in out.items()} | {"precision": names}).select(*events.columns, "precision")
    return add_noise(done, noise, noise_seed) if noise and noise_seed is not None else done


# --- rights of data subjects -----------------------------------------------------------


def access(events: DataFrame, entity_id: int) -> DataFrame:
    """Everything that is held on an entity."""
    return events.filter(F.col("entity_id") == entity_id)


def rectify(events: DataFrame, corrections: DataFrame) -> DataFrame:
    """Events with corrected columns in place: corrections (event_id and any event columns)."""
    named = [c for c in corrections.columns if c != "event_id"]
    new = corrections.select("event_id", *[F.col(c).alias(f"_{c}") for c in named])
    joined = events.join(new, "event_id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in named}).select(*events.columns)


def erase(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Events without those of the entities (entity_id)."""
    return events.join(entities.select("entity_id").distinct(), "entity_id", "left_anti")


def restrict(events: DataFrame, restricted: DataFrame) -> DataFrame:
    """Events that may be processed: not those of restricted or objecting entities, nor tombstones."""
    return erase(events, restricted).filter(~flag("deleted"))


def portable(events: DataFrame, entity_id: int) -> DataFrame:
    """An entity's events in a structured common form: one JSON document a row."""
    return access(events, entity_id).select("event_id", F.to_json(F.struct(*events.columns)).alias("document"))


def with_consent(events: DataFrame, consents: DataFrame, purpose: str, as_of_ns: int) -> DataFrame:
    """Events of entities that consent: (entity_id, purpose, granted_ns, withdrawn_ns) in force."""
    if not PURPOSES[ORDER[purpose]][6]:
        return events
    on = consents.filter((F.col("purpose") == purpose) & (F.col("granted_ns") <= as_of_ns) & (F.col("withdrawn_ns").isNull() | (F.col("withdrawn_ns") > as_of_ns)))
    return events.join(on.select("entity_id").distinct(), "entity_id", "left_semi")
