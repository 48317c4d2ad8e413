"""Events to and from CSV, JSON, NDJSON and GeoJSON, with schemas stated, never inferred.

Ids are written as 32 hex digits. Reading gives integers, or with ``wide`` the 32 digits
themselves, for ids of up to 128 bits; an id that an integer cannot hold makes its row malformed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fixed, from_hex, hex32, iso_time, parse_time, wide_hex
from ..model import FLAGS, NANO, div, flag
from ..state import keep

DELIMITERS = {"comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|"}
#: Columns of CSV exports, in order.
CSV_COLUMNS = ("id", "entity_id", "correlation_id", "latitude", "longitude", "timestamp_ns", "group_id", "ttl_seconds")
CSV_OPTIONAL = ("altitude_m", "velocity_ms", "heading_deg", "accuracy_m")
CSV_FLAGS = tuple(f"flag_{n}" for n in FLAGS)
MAX_ROW = 4096
#: Measures: text column, event column, units in one of it, digits.
MEASURES = (("altitude_m", "altitude_mm", 1000.0, 3), ("velocity_ms", "velocity_mms", 1000.0, 3), ("heading_deg", "heading_cdeg", 100.0, 2), ("accuracy_m", "accuracy_mm", 1000.0, 3))


def _is_wide(events: DataFrame) -> bool:
    return isinstance(events.schema["entity_id"].dataType, T.StringType)


def _hexed(name: str, wide: bool) -> Column:
    return F.col(name) if wide else hex32(F.col(name))


def _time(how: str) -> Column:
    t = F.col("ts_ns")
    if how == "iso8601":
        return iso_time(t)
    return div(t, {"unix_ns": 1, "unix_ms": 1_000_000, "unix_s": NANO}[how]).cast("string")


def csv_rows(events: DataFrame, time_format: str = "unix_ns", optional: bool = True) -> DataFrame:
    """Events as text columns in export units."""
    e = F.col
    hexed = lambda c: _hexed(c, _is_wide(events))
    out = [
        hexed("event_id").alias("id"), hexed("entity_id").alias("entity_id"), hexed("correlation_id").alias("correlation_id"),
        fixed(e("lat_nano") / F.lit(1e9), 9).alias("latitude"), fixed(e("lon_nano") / F.lit(1e9), 9).alias("longitude"),
        _time(time_format).alias("timestamp_ns"), e("group_id").cast("string").alias("group_id"), e("ttl_seconds").cast("string").alias("ttl_seconds"),
    ]
    if optional:
        out += [fixed(e(c) / F.lit(unit), digits).alias(name) for name, c, unit, digits in MEASURES]
    return events.select(*out, *[flag(n).cast("int").cast("string").alias(f"flag_{n}") for n in FLAGS])


def write_csv(events: DataFrame, path: str, delimiter: str = "comma", time_format: str = "unix_ns", optional: bool = True, header: bool = True) -> None:
    csv_rows(events, time_format, optional).write.option("sep", DELIMITERS[delimiter]).option("header", header).mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, delimiter: str = "comma", mapping: dict[str, str] | None = None, skip_malformed: bool = True, columns: list[str] | None = None, wide: bool = False) -> DataFrame:
    """Events of CSV files with a header (``mapping``: our names to theirs) or given ``columns``.

    Rows of more than ``MAX_ROW`` characters, or whose ids, place or time cannot be read, are
    dropped, or kept with ``malformed`` set.
    """
    names = columns or [*CSV_COLUMNS, *CSV_OPTIONAL, *CSV_FLAGS]
    reader = spark.read.option("sep", DELIMITERS[delimiter]).option("maxCharsPerColumn", -1).option("mode", "PERMISSIVE").option("enforceSchema", False)
    if columns:
        raw = reader.option("header", False).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    else:
        raw = reader.option("header", True).csv(path)  # names alone: all columns are text
    theirs = {n: (mapping or {}).get(n, n) for n in names}
    have = {n: F.col(f"`{t}`") for n, t in theirs.items() if t in raw.columns}
    get = lambda n, other="0": F.coalesce(have[n], F.lit(other)) if n in have else F.lit(other)
    size = sum((F.length(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in raw.columns), F.lit(max(0, len(raw.columns) - 1)))
    return _events(raw, get, skip_malformed, wide, size > MAX_ROW)


def check_csv(spark: SparkSession, path: str, **how) -> DataFrame:
    """A dry run of ``read_csv``: rows, and how many of them would come in or are malformed. Nothing is kept."""
    rows = read_csv(spark, path, **(how | {"skip_malformed": False}))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("malformed")).alias("readable"), F.count_if("malformed").alias("malformed"))


def import_csv(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], batch_rows: int = 1_000_000, **how) -> int:
    """Hand the events of CSV files to ``sink`` batch by batch; the number of batches.

    Rows are dealt to batches of about ``batch_rows`` by the files and offsets they stand at,
    which one written copy fixes; a batch that fails can be handed over again.
    """
    rows = keep(read_csv(spark, path, **how).withColumn("_at", F.monotonically_increasing_id()))
    batches = -(-rows.count() // batch_rows)
    for i in range(batches):
        sink(rows.filter(F.pmod(F.xxhash64("_at"), F.lit(batches)) == i).drop("_at"), i)
    return batches


def _events(raw: DataFrame, get, skip_malformed: bool, wide: bool = False, too_long: Column | None = None) -> DataFrame:
    """Text columns as events. ``too_long``: rows that are malformed by their size."""
    read = wide_hex if wide else from_hex
    none = F.lit("0" * 32) if wide else F.lit(0).cast("long")
    names = {"event_id": "id", "entity_id": "entity_id", "correlation_id": "correlation_id", "user_data": "user_data"}
    texts = {c: get(n, "") if c == "entity_id" else get(n) for c, n in names.items()}
    unread = F.lit(False)
    for t in texts.values():  # an id that is there but cannot be held is never cut
        unread = unread | ((F.trim(t) != "") & read(t).isNull())
    nano = lambda n: F.round(get(n, "").try_cast("double") * 1e9).cast("long")
    whole = lambda n: F.coalesce(get(n).try_cast("long"), F.lit(0).cast("long"))
    measure = lambda n, unit: F.coalesce(F.round(get(n).try_cast("double") * unit).cast("long"), F.lit(0).cast("long"))
    bits = sum((F.when(F.lower(get(f"flag_{n}")).isin("1", "true"), 1 << b).otherwise(0) for n, b in FLAGS.items()), F.lit(0).cast("long"))
    out = raw.select(
        F.coalesce(read(texts["event_id"]), none).alias("event_id"), read(texts["entity_id"]).alias("entity_id"), F.coalesce(read(texts["correlation_id"]), none).alias("correlation_id"),
        F.coalesce(read(texts["user_data"]), none).alias("user_data"), parse_time(get("timestamp_ns", "")).alias("ts_ns"), nano("latitude").alias("lat_nano"), nano("longitude").alias("lon_nano"),
        whole("group_id").alias("group_id"), *[measure(name, unit).alias(c) for name, c, unit, _ in MEASURES if c != "heading_cdeg"],
        measure("heading_deg", 100.0).alias("heading_cdeg"), whole("ttl_seconds").alias("ttl_seconds"), bits.alias("flags"), (unread | (F.lit(False) if too_long is None else too_long)).alias("_bad"),
    )
    bad = F.col("_bad") | F.col("entity_id").isNull() | F.col("lat_nano").isNull() | F.col("lon_nano").isNull() | F.col("ts_ns").isNull()
    bad = bad | (F.abs("lat_nano") > 90 * NANO) | (F.abs("lon_nano") > 180 * NANO)
    marked = out.withColumn("malformed", F.coalesce(bad, F.lit(True))).drop("_bad")
    return marked.filter("NOT malformed").drop("malformed") if skip_malformed else marked


# --- JSON ------------------------------------------------------------------------------


def event_json(include_nulls: bool = False, wide: bool = False) -> Column:
    """An event as a JSON object; optional fields that are 0 are left out. ``wide``: ids are 32 digits already."""
    e = F.col
    zero = lambda c: "0" * 32 if wide and c in ("correlation_id", "user_data") else 0
    some = lambda c, text: F.when(F.lit(include_nulls) | (e(c) != zero(c)), text)
    pair = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    quoted = lambda c: F.concat(F.lit('"'), _hexed(c, wide), F.lit('"'))
    flags = F.concat(F.lit("{"), F.concat_ws(",", *[pair(n, flag(n).cast("string")) for n in FLAGS]), F.lit("}"))
    parts = [
        pair("id", quoted("event_id")), pair("entity_id", quoted("entity_id")),
        some("correlation_id", pair("correlation_id", quoted("correlation_id"))), some("user_data", pair("user_data", quoted("user_data"))),
        pair("latitude", fixed(e("lat_nano") / F.lit(1e9), 9)), pair("longitude", fixed(e("lon_nano") / F.lit(1e9), 9)),
        pair("timestamp_ns", e("ts_ns").cast("string")), pair("timestamp_ms", div(e("ts_ns"), 1_000_000).cast("string")), pair("group_id", e("group_id").cast("string")),
        *[some(c, pair(name, fixed(e(c) / F.lit(unit), digits))) for name, c, unit, digits in MEASURES],
        some("ttl_seconds", pair("ttl_seconds", e("ttl_seconds").cast("string"))), pair("flags", flags),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def geojson_feature(wide: bool = False) -> Column:
    """An event as a GeoJSON feature: a point [longitude, latitude], the rest as properties."""
    place = F.concat(F.lit("["), fixed(F.col("lon_nano") / F.lit(1e9), 9), F.lit(","), fixed(F.col("lat_nano") / F.lit(1e9), 9), F.lit("]"))
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":'), place, F.lit('},"properties":'), event_json(wide=wide), F.lit("}"))


def write_ndjson(events: DataFrame, path: str) -> None:
    events.select(event_json(wide=_is_wide(events)).alias("value")).write.mode("overwrite").text(path)


def documents(events: DataFrame, kind: str, shard_rows: int = 100_000, order: str = "event_id") -> DataFrame:
    """(part, document): whole JSON or GeoJSON documents of at most about ``shard_rows`` events.

    A document needs its events together, so a data set becomes as many documents as bound
    one; each states its own count.
    """
    wide = _is_wide(events)
    body = event_json(wide=wide) if kind == "json" else geojson_feature(wide)
    parts = -(-max(1, events.count()) // shard_rows)
    rows = events.select(F.pmod(F.xxhash64(order), F.lit(parts)).alias("part"), F.struct(F.col(order), body.alias("body")).alias("e"))
    whole = rows.groupBy("part").agg(F.array_sort(F.collect_list("e")).alias("es"), F.count(F.lit(1)).alias("n"))
    head, tail = {
        "json": ('{"schema_version":"1.0","format":"json","events":[', '],"count":'),
        "geojson": ('{"type":"FeatureCollection","schema_version":"1.0","features":[', '],"totalFeatures":'),
    }[kind]
    text = F.concat(F.lit(head), F.array_join(F.transform("es", lambda x: x["body"]), ","), F.lit(tail), F.col("n").cast("string"), F.lit("}"))
    return whole.select("part", text.alias("document"))


def write_documents(events: DataFrame, path: str, kind: str, shard_rows: int = 100_000) -> None:
    documents(events, kind, shard_rows).select(F.col("document").alias("value")).write.mode("overwrite").text(path)


_EVENT = (
    "id string, entity_id string, correlation_id string, user_data string, latitude double, longitude double, timestamp_ns bigint, timestamp_ms bigint, "
    "group_id bigint, altitude_m double, velocity_ms double, heading_deg double, accuracy_m double, ttl_seconds bigint, flags struct<"
    + ", ".join(f"{n}:boolean" for n in FLAGS)
    + ">"
)
_EVENT_STRUCT = "struct<" + ", ".join(f"{p.split()[0]}:{p.split(None, 1)[1]}" for p in _EVENT.rsplit(", flags", 1)[0].split(", ")) + ", flags:struct<" + ", ".join(f"{n}:boolean" for n in FLAGS) + ">>"


def _from_struct(rows: DataFrame, skip_malformed: bool, wide: bool) -> DataFrame:
    """Rows with a struct column ``e`` of exported fields, as events."""
    named = {f"flag_{n}": F.col(f"e.flags.{n}").cast("string") for n in FLAGS}

    def get(name: str, other: str = "0") -> Column:
        if name in named:
            return F.coalesce(named[name], F.lit("0"))
        if name == "timestamp_ns":
            return F.coalesce(F.col("e.timestamp_ns"), F.col("e.timestamp_ms") * 1_000_000).cast("string")
        return F.coalesce(F.col(f"e.{name}").cast("string"), F.lit(other))

    return _events(rows, get, skip_malformed, wide)


def read_ndjson(spark: SparkSession, path: str, skip_malformed: bool = True, wide: bool = False) -> DataFrame:
    rows = spark.read.text(path).select(F.from_json("value", _EVENT_STRUCT).alias("e"))
    return _from_struct(rows, skip_malformed, wide)


def read_documents(spark: SparkSession, path: str, kind: str, skip_malformed: bool = True, wide: bool = False) -> DataFrame:
    """Events of JSON or GeoJSON documents: a document a line, or one over the lines of a whole file.

    A file is one task's, so documents should be of bounded size, as ``write_documents`` makes them.
    """
    files = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    each = F.forall(lines, lambda x: F.trim(x).startswith("{") & F.trim(x).endswith("}"))
    raw = files.select(F.explode(F.when(each, lines).otherwise(F.array("value"))).alias("value"))
    if kind == "json":
        rows = raw.select(F.explode(F.from_json("value", f"struct<events:array<{_EVENT_STRUCT}>>")["events"]).alias("e"))
    else:
        feature = f"struct<geometry:struct<coordinates:array<double>>, properties:{_EVENT_STRUCT}>"
        f = raw.select(F.explode(F.from_json("value", f"struct<features:array<{feature}>>")["features"]).alias("f"))
        place = F.col("f.geometry.coordinates")
        rows = f.select(F.col("f.properties").withField("longitude", place[0]).withField("latitude", place[1]).alias("e"))
    return _from_struct(rows, skip_malformed, wide)
