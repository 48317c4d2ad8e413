"""Read queries over a latest state: by id, by circle, by polygon, newest first.

Every read first has the newest row of each entity, then applies expiry, group, time and
place: an entity whose newest row does not qualify is absent, an older row never surfaces.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, s2
from ..functions.ttl import is_expired
from ..model import LAT_MAX, LON_MAX, QueryStatus, flag, reserved_ids
from .latest import live, order_of

#: Limits of requests.
BATCH_LIMIT, DEFAULT_LIMIT, MAX_LIMIT = 10_000, 1_000, 81_000
#: Fixed value: circles up to here are answered in order of latitude, larger ones of cell.
LATITUDE_ORDER_MM = 10_000_000
INDEX_ZEROED = ("correlation_id", "user_data", "altitude_mm", "velocity_mms", "accuracy_mm", "heading_cdeg", "flags")


@dataclass(frozen=True)
class QueryResult:
    """At most ``limit`` rows, and whether more would have matched."""

    df: DataFrame
    more: DataFrame | None = None
    status: QueryStatus = QueryStatus.OK

    @property
    def has_more(self) -> bool:
        """Exact: looks one row past the limit."""
        return self.more is not None and not self.more.isEmpty()


def limited(df: DataFrame, limit: int | None, order: Sequence[Column]) -> QueryResult:
    """The first rows in an order; without a limit all rows, in none: nothing meets in one task."""
    if limit is None:
        return QueryResult(df)
    if not 0 < limit <= MAX_LIMIT:
        raise ValueError(f"a limit is between 1 and {MAX_LIMIT}")
    ordered = df.orderBy(*order)
    return QueryResult(ordered.limit(limit), ordered.offset(limit).limit(1))


def filters(ts_min: int = 0, ts_max: int = 0, group_id: int = 0) -> Column:
    """Inclusive time bounds and group; 0 is no bound."""
    out = F.lit(True)
    if ts_min:
        out = out & (F.col("ts_ns") >= ts_min)
    if ts_max:
        out = out & (F.col("ts_ns") <= ts_max)
    return out & (F.col("group_id") == group_id) if group_id else out


def index_projection(df: DataFrame) -> DataFrame:
    """Rows as an index alone would give them: the fields that it does not hold are 0."""
    return df.withColumns({c: F.lit(0).cast(df.schema[c].dataType) for c in INDEX_ZEROED if c in df.columns})


def query_uuid(state: DataFrame, entity_id: int, as_of_ns: int) -> DataFrame:
    """One row: the entity asked for, a status, and its newest event unless absent or expired."""
    if entity_id in (0, "0" * 32):
        raise ValueError("entity id 0 is reserved")
    asked = state.sparkSession.createDataFrame([(entity_id,)], f"asked_id {state.schema['entity_id'].dataType.simpleString()}")
    own = state.filter((F.col("entity_id") == entity_id) & ~flag("deleted"))
    found = asked.join(own, F.col("asked_id") == F.col("entity_id"), "left")
    late = F.coalesce(is_expired(as_of_ns), F.lit(False))
    code = F.when(F.col("entity_id").isNull(), int(QueryStatus.ENTITY_NOT_FOUND)).when(late, int(QueryStatus.ENTITY_EXPIRED)).otherwise(0)
    return found.withColumn("status", code).select("asked_id", "status", *[F.when(F.col("status") == 0, F.col(c)).alias(c) for c in state.columns])


def query_uuid_batch(state: DataFrame, ids: Sequence[int], as_of_ns: int) -> DataFrame:
    """A row for each id asked for, in request order (``position``); ``found`` or nulls.

    The request is bounded by ``BATCH_LIMIT``, so it is the side that is broadcast.
    """
    if len(ids) > BATCH_LIMIT:
        raise ValueError(f"at most {BATCH_LIMIT} ids")
    kind = state.schema["entity_id"].dataType
    asked = state.sparkSession.createDataFrame(list(enumerate(ids)), f"position int, asked_id {kind.simpleString()}")
    wanted = asked.filter(F.col("asked_id") != reserved_ids(kind)[0])
    hits = live(state, as_of_ns).join(F.broadcast(wanted), F.col("entity_id") == F.col("asked_id"))
    hits = hits.select("position", *state.columns)
    return asked.join(hits, "position", "left").withColumn("found", F.col("entity_id").isNotNull())


def _coordinates(lat_nano: int, lon_nano: int) -> None:
    if abs(lat_nano) > LAT_MAX or abs(lon_nano) > LON_MAX:
        raise ValueError("coordinates out of range")


def radius_filter(lat_nano: int, lon_nano: int, radius_mm: int, semantics: str = "exact", cells: bool = False) -> Column:
    """A circle as predicates: a box and, for data laid out by cell, ranges; then the distance."""
    _coordinates(lat_nano, lon_nano)
    if radius_mm <= 0:
        raise ValueError("a radius is positive")
    lat, lon = F.col("lat_nano"), F.col("lon_nano")
    box = geo.reference_box if semantics == "reference" else geo.radius_box
    out = box(lat, lon, lat_nano, lon_nano, radius_mm)
    if cells:
        out = out & s2.in_ranges(F.col("cell_key"), s2.cover_circle(lat_nano, lon_nano, radius_mm))
    return out & geo.within_distance(lat, lon, lat_nano, lon_nano, radius_mm)


def _spatial_order(df: DataFrame, by_latitude: bool) -> list[Column]:
    if by_latitude or "cell_key" not in df.columns:
        return [F.col("lat_nano"), F.col("entity_id")]
    return [F.col("cell_key"), F.col("entity_id")]


def query_radius(
    state: DataFrame, lat_nano: int, lon_nano: int, radius_mm: int, as_of_ns: int, limit: int | None = DEFAULT_LIMIT,
    ts_min: int = 0, ts_max: int = 0, group_id: int = 0, semantics: str = "exact", projection: str = "full",
) -> QueryResult:
    """Live entities in a circle, bounds included; ``limit=None`` gives all of them.

    A limit takes the first by latitude up to 10 km, above that the first by cell, if the state has cells.
    """
    circle = radius_filter(lat_nano, lon_nano, radius_mm, semantics, "cell_key" in state.columns)
    hits = live(state, as_of_ns).filter(filters(ts_min, ts_max, group_id) & circle)
    hits = index_projection(hits) if projection == "index" else hits
    return limited(hits, limit, _spatial_order(hits, radius_mm <= LATITUDE_ORDER_MM))


def query_polygon(
    state: DataFrame, polygon: geo.Polygon, as_of_ns: int, limit: int | None = DEFAULT_LIMIT,
    ts_min: int = 0, ts_max: int = 0, group_id: int = 0, projection: str = "full",
) -> QueryResult:
    """Live entities inside a ring and outside its holes."""
    inside = geo.in_polygon(polygon, F.col("lat_nano"), F.col("lon_nano"))
    hits = live(state, as_of_ns).filter(filters(ts_min, ts_max, group_id) & inside)
    hits = index_projection(hits) if projection == "index" else hits
    return limited(hits, limit, _spatial_order(hits, False))


def query_latest(state: DataFrame, as_of_ns: int, limit: int | None = DEFAULT_LIMIT, group_id: int = 0, cursor_ts: int = 0) -> QueryResult:
    """Live entities, newest first; a cursor is the time below which to go on."""
    hits = live(state, as_of_ns).filter(filters(group_id=group_id))
    if cursor_ts:
        hits = hits.filter(F.col("ts_ns") < cursor_ts)
    return limited(hits, limit, [*order_of(hits), F.col("entity_id")])


def radius_pages(state: DataFrame, lat_nano: int, lon_nano: int, radius_mm: int, as_of_ns: int, limit: int, after: tuple[int, int] | None = None) -> QueryResult:
    """Pages of a circle by (latitude, entity): ``after`` is the last row of the page before."""
    hits = live(state, as_of_ns).filter(radius_filter(lat_nano, lon_nano, radius_mm))
    if after:
        lat, entity = after
        hits = hits.filter((F.col("lat_nano") > lat) | ((F.col("lat_nano") == lat) & (F.col("entity_id") > entity)))
    return limited(hits, limit, [F.col("lat_nano"), F.col("entity_id")])


def post_filter_statistics(candidates: DataFrame, place: Column, as_of_ns: int, ts_min: int = 0, ts_max: int = 0) -> DataFrame:
    """What each filter turns away, in the order deletion, time, expiry, place: one aggregate.

    ``false_positives`` is the share of candidates that a coarse index let through in vain.
    """
    gone, late = flag("deleted"), is_expired(as_of_ns, "cold")
    in_time = filters(ts_min, ts_max)
    first = F.when(gone, "deleted").when(~in_time, "time").when(late, "expired").when(~place, "place").otherwise("passed")
    counts = candidates.select(first.alias("r")).agg(
        F.count(F.lit(1)).alias("candidates"), *[F.count_if(F.col("r") == x).alias(x) for x in ("deleted", "time", "expired", "place", "passed")]
    )
    share = (F.col("candidates") - F.col("passed")) / F.greatest(F.col("candidates"), F.lit(1))
    return counts.withColumn("false_positives", F.round(share, 6))


def spatial_join(events: DataFrame, zones: list[tuple[str, geo.Polygon]]) -> DataFrame:
    """Every event with the names of the zones it lies in (an extension: not a reference query).

    Zones are literals of the query, so this is one pass without a join.
    """
    named = [F.when(geo.in_polygon(p, F.col("lat_nano"), F.col("lon_nano")), F.lit(n)) for n, p in zones]
    return events.withColumn("zones", F.array_compact(F.array(*named)) if named else F.array().cast(T.ArrayType(T.StringType())))
