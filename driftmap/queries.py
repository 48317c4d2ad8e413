"""Registered queries, one or more per operator, over events derived from the ``events`` table.

Each takes (spark, sf_dir) and covers its whole table; SQL gives the same rows in DuckDB.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, s2, sql, text, ttl
from .model import COLUMNS, ENTITY_ID_MAX, EVENTS_SQL, NANO, geo_events
from .operators import bulk, cliffs, incremental, minimize, reads, regions, transforms, validation, writes
from .operators.latest import latest, live, scatter_merge, status
from .plans.engine import Engine, Query
from .sources import files
from .state import shared_dir
from .streaming import cdc

#: Time of all queries: 2024-01-31 00:00 UTC. No query reads a clock.
AS_OF = 1_706_659_200 * NANO
CENTRE = (40 * NANO, -74 * NANO)
RING = ((39_400_000_000, -74_800_000_000), (39_300_000_000, -73_300_000_000), (40_100_000_000, -73_700_000_000), (40_800_000_000, -73_200_000_000), (40_600_000_000, -74_700_000_000))
HOLE = ((39_800_000_000, -74_300_000_000), (39_800_000_000, -73_950_000_000), (40_200_000_000, -74_000_000_000))
REGIONS = [(1, 40_700_000_000, -74_000_000_000), (2, 39_300_000_000, -74_900_000_000), (3, 40_000_000_000, -73_000_000_000)]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# --- SQL building blocks ---------------------------------------------------------------

_G = f"WITH g AS ({EVENTS_SQL})"
_LATEST = "SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts_ns DESC, event_id DESC) AS _r FROM {0}) WHERE _r = 1"
_L = f"{_G}, latest AS ({_LATEST.format('g')}), live AS (SELECT * FROM latest WHERE (flags & 32) = 0 AND NOT {ttl.expired_sql(AS_OF)})"
_ALL = ", ".join(COLUMNS)


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(geo_events(spark, sf_dir))


def _cell_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).withColumn("cell_key", s2.cell_key(F.col("lat_nano"), F.col("lon_nano")))


def _cells_sql() -> str:
    """Level-30 cells of g in plain SQL: unit vector, face, position on it, then 30 steps along the curve."""
    table = lambda t: "[" + ", ".join(str(int(x)) for x in t.ravel()) + "]"
    steps = "SELECT event_id, face, i, j, 0::HUGEINT AS pos, face % 2 AS turn FROM ij"
    for k in range(s2.LEVELS - 1, -1, -1):
        q = f"turn * 4 + ((i >> {k}) & 1) * 2 + ((j >> {k}) & 1) + 1"
        steps = f"SELECT event_id, face, i, j, pos * 4 + p AS pos, xor(turn, list_extract({table(s2.POS_TURN)}, p + 1)) AS turn FROM (SELECT *, list_extract({table(s2.IJ_TO_POS)}, {q}) AS p FROM ({steps}))"
    st = lambda w: f"CASE WHEN {w} >= 0 THEN 0.5 * sqrt(1 + 3 * abs({w})) ELSE 1 - 0.5 * sqrt(1 + 3 * abs({w})) END"
    ij = lambda w: f"CAST(least(greatest(floor(({st(w)}) * {s2.SIZE}), 0), {s2.SIZE - 1}) AS BIGINT)"
    pick = lambda *v: "CASE face " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(v)) + " END / major"
    return f"""ll AS (SELECT event_id, lat_nano / 1e9::DOUBLE * {math.pi / 180!r} AS phi, CASE WHEN lon_nano >= 180000000000 THEN 179999999999 ELSE lon_nano END / 1e9::DOUBLE * {math.pi / 180!r} AS theta FROM g),
  xyz AS (SELECT event_id, cos(phi) * cos(theta) AS x, cos(phi) * sin(theta) AS y, sin(phi) AS z FROM ll),
  ax AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN 0 WHEN abs(y) >= abs(z) THEN 1 ELSE 2 END AS axis FROM xyz),
  f AS (SELECT *, list_extract([x, y, z], axis + 1) AS major, axis + CASE WHEN list_extract([x, y, z], axis + 1) < 0 THEN 3 ELSE 0 END AS face FROM ax),
  uv AS (SELECT event_id, face, {pick("y", "-x", "-x", "z", "z", "-y")} AS u, {pick("z", "z", "-y", "y", "-x", "-x")} AS v FROM f),
  ij AS (SELECT event_id, face, {ij("u")} AS i, {ij("v")} AS j FROM uv),
  cells AS (SELECT event_id, CAST(face::HUGEINT * {1 << 61} + pos * 2 + 1 - 9223372036854775808 AS BIGINT) AS cell_key FROM ({steps}))"""


def _circle(radius_mm: int) -> str:
    return f"floor({geo.haversine_sql(str(CENTRE[0]), str(CENTRE[1]), 'lat_nano', 'lon_nano')}) <= {radius_mm}"


_CELLS = f"{_L}, {_cells_sql()}"


def _mixed_sql(name: str, source: str, columns: str, low: str, high: str) -> str:
    """CTEs that end in ``name``: the shard key of 128-bit ids given as two halves, modulo 2^64."""
    out, at = [], f"{name}_0"
    out.append(f"{at} AS (SELECT {columns}, ({low})::HUGEINT AS a, ({high})::HUGEINT AS b FROM {source})")
    wrap = lambda x, c: f"((({x} >> 32) * {c} % 4294967296) * 4294967296 + ({x} & 4294967295) * {c}) % 18446744073709551616"
    for k, c in enumerate(regions.FINALISER, 1):
        out.append(f"{name}_{k}x AS (SELECT * REPLACE (xor(a, a >> 33) AS a, xor(b, b >> 33) AS b) FROM {at})")
        out.append(f"{name}_{k} AS (SELECT * REPLACE ({wrap('a', c)} AS a, {wrap('b', c)} AS b) FROM {name}_{k}x)")
        at = f"{name}_{k}"
    keep_ = ", ".join(x.split(" AS ")[-1].strip() for x in columns.split(","))
    out.append(f"{name} AS (SELECT {keep_}, xor(xor(a, a >> 33), xor(b, b >> 33)) AS key FROM {at})")
    return ", ".join(out)


def _shards_sql() -> str:
    """Entities' keys, their places by jump hash for 8 and 16 shards, and the ring of 16 shards."""
    jump = lambda n: f"""k{n}(entity_id, key, b, j) AS (SELECT entity_id, key, -1::BIGINT, 0::BIGINT FROM keys UNION ALL
      SELECT entity_id, key2, j, CAST(trunc((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((key2 >> 33) + 1)::DOUBLE)) AS BIGINT) FROM (
        SELECT *, (((key >> 32) * {regions.JUMP_STEP} % 4294967296) * 4294967296 + (key & 4294967295) * {regions.JUMP_STEP} + 1) % 18446744073709551616 AS key2 FROM k{n} WHERE j < {n}))"""  # noqa: E731
    return (
        f"{_G.replace('WITH', 'WITH RECURSIVE', 1)}, ids AS (SELECT DISTINCT entity_id FROM g), {_mixed_sql('keys', 'ids', 'entity_id', 'entity_id', '0')}, {jump(8)}, {jump(16)}, "
        f"jumped AS (SELECT x.entity_id, x.b AS j8, y.b AS j16 FROM (SELECT entity_id, max(b) AS b FROM k8 GROUP BY 1) x JOIN (SELECT entity_id, max(b) AS b FROM k16 GROUP BY 1) y USING (entity_id)), "
        f"nodes AS (SELECT s AS shard, n AS node FROM range(16) t(s), range({regions.VNODES}) u(n)), {_mixed_sql('points', 'nodes', 'shard, node', 'node', 'shard')}, ring AS (SELECT key AS spot, min(shard) AS shard FROM points GROUP BY key)"
    )


_SHARDS = _shards_sql()

# --- reads -----------------------------------------------------------------------------


@query("geo_events", f"{_G} SELECT * FROM g")
def _(spark, d):
    return geo_events(spark, d)


@query("latest_build", f"{_L} SELECT * FROM latest")
def _(spark, d):
    return _state(spark, d)


@query("latest_live", f"{_L} SELECT * FROM live")
def _(spark, d):
    return live(_state(spark, d), AS_OF)


@query("query_uuid", f"{_L} SELECT 7 AS asked_id, 0 AS status, live.* FROM live WHERE entity_id = 7 UNION ALL BY NAME SELECT 7 AS asked_id, CASE WHEN (SELECT count(*) FROM latest WHERE entity_id = 7 AND (flags & 32) = 0) = 0 THEN 200 ELSE 210 END AS status WHERE NOT EXISTS (SELECT 1 FROM live WHERE entity_id = 7)")
def _(spark, d):
    return reads.query_uuid(_state(spark, d), 7, AS_OF)


@query("query_uuid_missing", f"{_L} SELECT 4611686018427387903 AS asked_id, 200 AS status, latest.* FROM (SELECT 1) LEFT JOIN latest ON false")
def _(spark, d):
    return reads.query_uuid(_state(spark, d), 2**62 - 1, AS_OF)


@query("query_uuid_batch", f"{_L}, asked AS (SELECT CAST(i AS INT) AS position, (i * 3) % 2000 AS asked_id FROM range(10000) t(i)) SELECT asked.position, asked_id, live.*, live.entity_id IS NOT NULL AS found FROM asked LEFT JOIN live ON asked_id <> 0 AND entity_id = asked_id")
def _(spark, d):
    return reads.query_uuid_batch(_state(spark, d), [i * 3 % 2000 for i in range(10_000)], AS_OF)


def _radius(radius_mm: int):
    return lambda spark, d: reads.query_radius(_state(spark, d), *CENTRE, radius_mm, AS_OF, limit=None).df


for _km in (1, 10, 60, 100):
    query(f"query_radius_{_km}km", f"{_L} SELECT * FROM live WHERE {_circle(_km * 1_000_000)}")(_radius(_km * 1_000_000))


@query("query_radius_filters", f"{_L} SELECT * FROM live WHERE {_circle(90_000_000)} AND ts_ns >= {AS_OF - 5 * 86400 * NANO} AND ts_ns <= {AS_OF - 86400 * NANO} AND group_id = 3")
def _(spark, d):
    return reads.query_radius(_state(spark, d), *CENTRE, 90_000_000, AS_OF, None, AS_OF - 5 * 86400 * NANO, AS_OF - 86400 * NANO, 3).df


@query("query_radius_limit", f"{_CELLS} SELECT live.*, cell_key FROM live JOIN cells ON cells.event_id = live.event_id WHERE {_circle(80_000_000)} ORDER BY cell_key, entity_id LIMIT 7")
def _(spark, d):
    return reads.query_radius(_cell_state(spark, d), *CENTRE, 80_000_000, AS_OF, limit=7).df


@query("query_radius_limit_near", f"{_L} SELECT * FROM live WHERE {_circle(9_000_000)} ORDER BY lat_nano, entity_id LIMIT 3")
def _(spark, d):
    return reads.query_radius(_state(spark, d), *CENTRE, 9_000_000, AS_OF, limit=3).df


@query("query_radius_laid_out", f"{_L} SELECT * FROM live WHERE {_circle(30_000_000)}")
def _(spark, d):
    """Over a state kept on disk in order of cells: ranges and box reach the scan."""
    path = f"{shared_dir(spark).rstrip('/')}/driftmap-state-{uuid.uuid4().hex}"
    writes.layout(_cell_state(spark, d), path, max(1, spark.sparkContext.defaultParallelism))
    state = spark.read.parquet(path)
    return reads.query_radius(state, *CENTRE, 30_000_000, AS_OF, limit=None).df.drop("cell_key")


@query("query_radius_page", f"{_L} SELECT * FROM live WHERE {_circle(80_000_000)} AND lat_nano > 39900000000 ORDER BY lat_nano, entity_id LIMIT 5")
def _(spark, d):
    return reads.radius_pages(_state(spark, d), *CENTRE, 80_000_000, AS_OF, 5, (39_900_000_000, 2**62)).df


@query("query_radius_index", f"{_L} SELECT * REPLACE (0 AS correlation_id, 0 AS user_data, 0 AS altitude_mm, 0 AS velocity_mms, 0 AS accuracy_mm, 0 AS heading_cdeg, 0 AS flags) FROM live WHERE {_circle(60_000_000)}")
def _(spark, d):
    return reads.query_radius(_state(spark, d), *CENTRE, 60_000_000, AS_OF, limit=None, projection="index").df


@query("query_radius_reference", f"{_L} SELECT * FROM live WHERE {_circle(60_000_000)} AND lat_nano BETWEEN {CENTRE[0] - int(60_000_000 * NANO / geo.BOX_MM_PER_DEGREE)} AND {CENTRE[0] + int(60_000_000 * NANO / geo.BOX_MM_PER_DEGREE)}")
def _(spark, d):
    return reads.query_radius(_state(spark, d), *CENTRE, 60_000_000, AS_OF, limit=None, semantics="reference").df


@query("radius_over_log", f"{_G} SELECT * FROM g WHERE {_circle(60_000_000)}")
def _(spark, d):
    return geo_events(spark, d).filter(reads.radius_filter(*CENTRE, 60_000_000))


def _many(n: int) -> list[geo.Vertex]:
    """A star-shaped ring of n vertices with integer corners."""
    out = []
    for i in range(n):
        side, at = divmod(i * 4 * 1_000_000 // n, 1_000_000)
        r = 600_000_000 + (i % 3) * 60_000_000
        x, y = [(at - 500_000, -500_000), (500_000, at - 500_000), (500_000 - at, 500_000), (-500_000, 500_000 - at)][side]
        out.append((40 * NANO + y * r // 500_000, -74 * NANO + x * r // 500_000))
    return out


@query("query_polygon", f"{_L} SELECT * FROM live WHERE {geo.in_ring_sql(RING)}")
def _(spark, d):
    return reads.query_polygon(_state(spark, d), geo.Polygon.of(RING), AS_OF, None).df


@query("query_polygon_holes", f"{_L} SELECT * FROM live WHERE {geo.in_ring_sql(RING)} AND NOT {geo.in_ring_sql(HOLE)}")
def _(spark, d):
    return reads.query_polygon(_state(spark, d), geo.Polygon.of(RING, [HOLE]), AS_OF, None).df


@query("query_polygon_64", f"{_L} SELECT * FROM live WHERE {geo.in_ring_sql(_many(64))}")
def _(spark, d):
    return reads.query_polygon(_state(spark, d), geo.Polygon.of(_many(64)), AS_OF, None).df


@query("polygon_over_log_200", f"{_G} SELECT * FROM g WHERE {geo.in_ring_sql(_many(200))}")
def _(spark, d):
    return geo_events(spark, d).filter(geo.in_polygon(geo.Polygon.of(_many(200)), F.col("lat_nano"), F.col("lon_nano")))


@query("query_polygon_filters", f"{_L} SELECT * FROM live WHERE {geo.in_ring_sql(RING)} AND group_id = 5 AND ts_ns >= {AS_OF - 10 * 86400 * NANO}")
def _(spark, d):
    return reads.query_polygon(_state(spark, d), geo.Polygon.of(RING), AS_OF, None, AS_OF - 10 * 86400 * NANO, 0, 5).df


@query("query_latest", f"{_L} SELECT * FROM live ORDER BY ts_ns DESC, event_id DESC LIMIT 25")
def _(spark, d):
    return reads.query_latest(_state(spark, d), AS_OF, 25).df


@query("query_latest_group_cursor", f"{_L} SELECT * FROM live WHERE group_id = 2 AND ts_ns < {AS_OF - 86400 * NANO} ORDER BY ts_ns DESC, event_id DESC LIMIT 10")
def _(spark, d):
    return reads.query_latest(_state(spark, d), AS_OF, 10, 2, AS_OF - 86400 * NANO).df


@query("batch_query", f"{_L} SELECT 0 AS query_id, * FROM live WHERE entity_id = 11 UNION ALL SELECT 1, * FROM live WHERE {_circle(40_000_000)} UNION ALL SELECT 3, * FROM live WHERE {geo.in_ring_sql(RING)} UNION ALL (SELECT 4, * FROM live ORDER BY ts_ns DESC, event_id DESC LIMIT 3)")
def _(spark, d):
    e = Engine(spark, geo_events(spark, d))
    ring = [(a / NANO, b / NANO) for a, b in RING]
    asked = [
        Query("uuid", {"entity_id": 11}),
        Query("radius", {"latitude": 40.0, "longitude": -74.0, "radius_m": 40_000, "limit": None}),
        Query("radius", {"latitude": 40.0, "longitude": -74.0, "radius_m": -1}),
        Query("polygon", {"vertices": ring, "limit": None}),
        Query("latest", {"limit": 3}),
    ]
    return e.batch(asked, AS_OF)[0]


@query("prepared_radius", f"{_L} SELECT * FROM live WHERE {_circle(30_000_000)} ORDER BY lat_nano, entity_id LIMIT 500")
def _(spark, d):
    e = Engine(spark, geo_events(spark, d))
    e.prepare("near", "RADIUS $1 $2 $3 LIMIT $4")
    return e.execute("near", AS_OF, 40.0, -74.0, 30_000, 500).df


@query("prepared_latest", f"{_L} SELECT * FROM live WHERE group_id = 4 ORDER BY ts_ns DESC, event_id DESC LIMIT 6")
def _(spark, d):
    e = Engine(spark, geo_events(spark, d))
    return e.execute(e.prepare("newest", "LATEST LIMIT $1 GROUP $2"), AS_OF, 6, 4).df


@query("console_radius", f"{_L} SELECT * FROM live WHERE {_circle(50_000_000)} ORDER BY lat_nano, entity_id LIMIT 20")
def _(spark, d):
    return Engine(spark, geo_events(spark, d)).query("QUERY RADIUS (40.0, -74.0) 50000 LIMIT 20;", AS_OF)


@query("console_latest_ids", f"{_L} SELECT * FROM live WHERE entity_id IN (5, 6, 255) ORDER BY ts_ns DESC LIMIT 100")
def _(spark, d):
    return Engine(spark, geo_events(spark, d)).query("query latest 5 6 0xff", AS_OF)


@query("get_status", f"{_L} SELECT count(*) AS n_rows, count(*) FILTER ((flags & 32) = 0) AS entities, count(*) FILTER ((flags & 32) <> 0) AS tombstones, count(*) FILTER ((flags & 32) = 0 AND {ttl.expired_sql(AS_OF)}) AS expired, count(*) FILTER ((flags & 32) = 0 AND NOT {ttl.expired_sql(AS_OF)}) AS live, round(count(*) FILTER ((flags & 32) <> 0) / greatest(count(*), 1), 6) AS tombstone_ratio FROM latest")
def _(spark, d):
    return status(_state(spark, d), AS_OF)


@query("scatter_merge", f"{_L} SELECT * FROM latest ORDER BY ts_ns DESC, event_id DESC, entity_id LIMIT 50")
def _(spark, d):
    g = geo_events(spark, d)
    return scatter_merge([g.filter("event_id % 2 = 0"), g.filter("event_id % 2 = 1")], 50)


@query("scan_union", f"{_G} SELECT * FROM g WHERE group_id = 1 OR velocity_mms > 39000")
def _(spark, d):
    g = geo_events(spark, d)
    return g.filter((F.col("group_id") == 1) | (F.col("velocity_mms") > 39_000))


@query("scan_intersection", f"{_G} SELECT * FROM g WHERE group_id = 1 INTERSECT SELECT * FROM g WHERE velocity_mms > 20000")
def _(spark, d):
    g = geo_events(spark, d)
    return g.filter("group_id = 1").intersect(g.filter("velocity_mms > 20000"))


@query("scan_difference", f"{_G} SELECT * FROM g WHERE group_id = 1 EXCEPT SELECT * FROM g WHERE velocity_mms > 20000")
def _(spark, d):
    g = geo_events(spark, d)
    return g.filter("group_id = 1").exceptAll(g.filter("velocity_mms > 20000")).distinct()


@query("scan_time_range", f"{_G} SELECT * FROM g WHERE ts_ns BETWEEN {AS_OF - 9 * 86400 * NANO} AND {AS_OF - 7 * 86400 * NANO}")
def _(spark, d):
    return geo_events(spark, d).filter(F.col("ts_ns").between(AS_OF - 9 * 86400 * NANO, AS_OF - 7 * 86400 * NANO))


@query("zones_of_events", f"{_G} SELECT event_id, concat_ws(',', CASE WHEN {geo.in_ring_sql(RING)} THEN 'ring' END, CASE WHEN {geo.in_ring_sql(HOLE)} THEN 'hole' END) AS zones FROM g")
def _(spark, d):
    zones = [("ring", geo.Polygon.of(RING)), ("hole", geo.Polygon.of(HOLE))]
    return reads.spatial_join(geo_events(spark, d), zones).select("event_id", F.array_join("zones", ",").alias("zones"))


@query("post_filter_statistics", f"""{_L}, c AS (SELECT CASE WHEN (flags & 32) <> 0 THEN 'deleted' WHEN NOT ts_ns >= {AS_OF - 20 * 86400 * NANO} THEN 'time' WHEN {ttl.expired_sql(AS_OF, 'cold')} THEN 'expired'
  WHEN NOT {geo.in_ring_sql(RING)} THEN 'place' ELSE 'passed' END AS r FROM g) SELECT count(*) AS candidates, {", ".join(f"count(*) FILTER (r = '{x}') AS {x}" for x in ("deleted", "time", "expired", "place", "passed"))},
  round((count(*) - count(*) FILTER (r = 'passed')) / greatest(count(*), 1), 6) AS false_positives FROM c""")  # fmt: skip
def _(spark, d):
    place = geo.in_ring(RING, F.col("lat_nano"), F.col("lon_nano"))
    return reads.post_filter_statistics(geo_events(spark, d), place, AS_OF, AS_OF - 20 * 86400 * NANO)


@query("sql_functions", f"{_L} SELECT event_id, (flags & 4) <> 0 AS still FROM live WHERE {_circle(45_000_000)}")
def _(spark, d):
    sql.register(spark)
    _state(spark, d).createOrReplaceTempView("driftmap_latest")
    return spark.sql(
        f"SELECT event_id, event_flag(flags, 'stationary') AS still FROM driftmap_latest WHERE NOT event_flag(flags, 'deleted') "
        f"AND NOT ttl_expired(ts_ns, ttl_seconds, {AS_OF}) AND st_within_radius(lat_nano, lon_nano, {CENTRE[0]}, {CENTRE[1]}, 45000000)"
    )


# --- functions -------------------------------------------------------------------------


@query("haversine", f"{_G} SELECT event_id, CAST(round({geo.haversine_sql(str(CENTRE[0]), str(CENTRE[1]), 'lat_nano', 'lon_nano')} / 1000) AS BIGINT) AS metres FROM g")
def _(spark, d):
    far = geo.haversine_mm(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat_nano"), F.col("lon_nano"))
    return geo_events(spark, d).select("event_id", F.round(far / 1000).cast("long").alias("metres"))


@query("ttl_rules", f"{_G} SELECT event_id, {ttl.expired_sql(AS_OF)} AS by_read, {ttl.expired_sql(AS_OF, 'cleanup')} AS by_cleanup, {ttl.expired_sql(AS_OF, 'cold')} AS by_cold, CASE WHEN ttl_seconds > 0 THEN greatest(0, (ts_ns + ttl_seconds * {NANO} - {AS_OF}) // {NANO}) END AS remaining FROM g")
def _(spark, d):
    return geo_events(spark, d).select(
        "event_id", *[ttl.is_expired(AS_OF, m).alias(f"by_{m}") for m in ("read", "cleanup", "cold")], ttl.remaining_seconds(AS_OF).alias("remaining")
    )


@query("ttl_extension", f"""{_G} SELECT event_id, CASE WHEN ttl_seconds = 0 THEN 'no_ttl' WHEN flags % 4 = 3 THEN 'no_auto_extend' WHEN event_id % 6 >= 5 THEN 'max_count_exceeded'
  WHEN ts_ns > 0 AND greatest({AS_OF} - ts_ns, 0) < {ttl.EXTEND_COOLDOWN * NANO} THEN 'cooldown_active' WHEN least(ttl_seconds + 86400, 259200) = ttl_seconds THEN 'max_ttl_reached' ELSE 'extended' END AS result,
  CASE WHEN ttl_seconds = 0 THEN 0 WHEN flags % 4 = 3 OR event_id % 6 >= 5 OR (ts_ns > 0 AND greatest({AS_OF} - ts_ns, 0) < {ttl.EXTEND_COOLDOWN * NANO}) THEN ttl_seconds ELSE least(ttl_seconds + 86400, 259200) END AS new_ttl FROM g""")  # fmt: skip
def _(spark, d):
    e = ttl.extension(AS_OF, F.col("ttl_seconds"), F.expr("flags % 4 = 3"), F.expr("event_id % 6"), F.col("ts_ns"), cap=259_200, most=5)
    return geo_events(spark, d).select("event_id", e.alias("e")).select("event_id", "e.result", "e.new_ttl")


@query("s2_cells", f"{_CELLS} SELECT event_id, cell_key, CAST((cell_key::HUGEINT + 9223372036854775808) // {1 << 41} * {1 << 41} + {1 << 40} - 9223372036854775808 AS BIGINT) AS parent_10 FROM cells")
def _(spark, d):
    g = geo_events(spark, d).withColumn("cell_key", s2.cell_key(F.col("lat_nano"), F.col("lon_nano")))
    return g.select("event_id", "cell_key", s2.parent_key(F.col("cell_key"), 10).alias("parent_10"))


@query("query_radius_cells", f"{_L} SELECT event_id, entity_id, lat_nano, lon_nano FROM live WHERE {_circle(25_000_000)}")
def _(spark, d):
    g = _state(spark, d).withColumn("cell_key", s2.cell_key(F.col("lat_nano"), F.col("lon_nano")))
    return reads.query_radius(g, *CENTRE, 25_000_000, AS_OF, None).df.select("event_id", "entity_id", "lat_nano", "lon_nano")


@query("shard_keys", f"{_SHARDS}, r AS (SELECT k.entity_id, coalesce(min(p.spot), (SELECT min(spot) FROM ring)) AS spot FROM keys k LEFT JOIN ring p ON p.spot >= k.key GROUP BY k.entity_id) SELECT k.entity_id, CAST(k.key % 16 AS BIGINT) AS modulo, j16 AS jump, CAST(ring.shard AS BIGINT) AS ring FROM keys k JOIN jumped USING (entity_id) JOIN r USING (entity_id) JOIN ring ON ring.spot = r.spot")
def _(spark, d):
    ids = geo_events(spark, d).select("entity_id").distinct()
    return ids.select("entity_id", *[regions.shard(F.col("entity_id"), 16, s).alias(s) for s in ("modulo", "jump", "ring")])


@query("shard_statistics", f"{_SHARDS}, n AS (SELECT i, coalesce(sum(c), 0) AS n FROM range(16) t(i) LEFT JOIN (SELECT j16, count(*) AS c FROM g JOIN jumped USING (entity_id) GROUP BY j16) ON j16 = i GROUP BY i) SELECT CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation, round(max(n) / avg(n), 6) AS imbalance FROM n")
def _(spark, d):
    return regions.shard_statistics(geo_events(spark, d), 16)


@query("resharding_plan", f"{_SHARDS} SELECT j8 AS source, j16 AS target, count(DISTINCT entity_id) AS entities, count(*) AS n_rows FROM g JOIN jumped USING (entity_id) WHERE j8 <> j16 GROUP BY ALL")
def _(spark, d):
    return regions.moved(geo_events(spark, d), 8, 16)


@query("migration_batches", f"{_SHARDS} SELECT entity_id, j8 AS source, j16 AS target, count(*) AS n_rows FROM g JOIN jumped USING (entity_id) WHERE j8 <> j16 GROUP BY ALL")
def _(spark, d):
    return regions.migration_batches(geo_events(spark, d), 8, 16, 10).drop("batch")


_FAR = [geo.haversine_sql("lat_nano", "lon_nano", str(a), str(b)) for _, a, b in REGIONS]


@query("nearest_region", f"{_G}, f AS (SELECT event_id, {', '.join(f'{x} AS d{i}' for i, x in enumerate(_FAR))} FROM g) SELECT event_id, CAST(CASE WHEN d0 <= d1 AND d0 <= d2 THEN 1 WHEN d1 <= d2 THEN 2 ELSE 3 END AS INT) AS region_id, CAST(round(least(d0, d1, d2) / 1000) AS BIGINT) AS region_m FROM f")
def _(spark, d):
    return regions.nearest_region(geo_events(spark, d), REGIONS).select("event_id", "region_id", "region_m")


@query("tiers", f"""{_G.replace("WITH", "WITH RECURSIVE", 1)}, a AS (SELECT entity_id, ts_ns AS t, row_number() OVER (PARTITION BY entity_id ORDER BY ts_ns) AS n FROM g),
  w(entity_id, n, tier, start, k, last, ups) AS (SELECT entity_id, n, 0, t, 1, t, 0 FROM a WHERE n = 1 UNION ALL
    SELECT entity_id, n, CASE WHEN up THEN now - 1 ELSE now END, CASE WHEN reset THEN t ELSE start END, CASE WHEN up THEN 0 ELSE k END, t, ups + CASE WHEN up THEN 1 ELSE 0 END
    FROM (SELECT *, (now = 2 AND k >= 3) OR (now = 1 AND k >= 10) AS up FROM (SELECT *, CASE WHEN reset THEN 1 ELSE k0 + 1 END AS k FROM (
      SELECT *, now = 2 AND tier < 2 OR t - start > {3600 * NANO} AS reset FROM (
        SELECT w.entity_id, a.n, a.t, w.start, w.k AS k0, w.ups, w.tier, CASE WHEN w.tier <= 1 AND a.t - w.last >= {86400 * NANO} THEN 2 WHEN w.tier = 0 AND a.t - w.last >= {3600 * NANO} THEN 1 ELSE w.tier END AS now
        FROM w JOIN a ON a.entity_id = w.entity_id AND a.n = w.n + 1))))),
  e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC) AS _r FROM w) WHERE _r = 1)
  SELECT entity_id, CASE WHEN tier <= 1 AND {AS_OF} - last >= {86400 * NANO} THEN 'cold' WHEN tier = 0 AND {AS_OF} - last >= {3600 * NANO} THEN 'warm' ELSE list_extract(['hot', 'warm', 'cold'], tier + 1) END AS tier, last AS last_access_ns, CAST(ups AS BIGINT) AS promotions FROM e""")  # fmt: skip
def _(spark, d):
    return regions.tiers(geo_events(spark, d).select("entity_id", "ts_ns"), AS_OF)


@query("vector_clocks", f"""{_G}, c AS (SELECT event_id, event_id % 5 AS a1, event_id % 3 AS a2, event_id % 4 AS b1, event_id % 2 AS b3, velocity_mms AS ln, accuracy_mm AS rn FROM g),
  k AS (SELECT *, (a1 < b1 OR 0 < b3) AS lt, (a1 > b1 OR a2 > 0) AS gt FROM c), n AS (SELECT *, CASE WHEN lt AND gt THEN 'concurrent' WHEN lt THEN 'less_than' WHEN gt THEN 'greater_than' ELSE 'equal' END AS comparison FROM k)
  SELECT event_id, comparison, CASE WHEN comparison = 'concurrent' THEN CASE WHEN rn > ln THEN 'remote' ELSE 'local' END WHEN comparison = 'less_than' THEN 'remote' ELSE 'local' END AS winner FROM n""")  # fmt: skip
def _(spark, d):
    e = geo_events(spark, d).selectExpr(
        "event_id", "map(1, event_id % 5, 2, event_id % 3) AS local_clock", "map(1, event_id % 4, 3, event_id % 2) AS remote_clock",
        "velocity_mms AS local_ns", "accuracy_mm AS remote_ns", "2 AS remote_region",
    )
    return regions.resolve(e).select("event_id", "comparison", "winner")


# --- writes ----------------------------------------------------------------------------

#: A batch: every fifth event, some made invalid; the rest is the log behind the state.
_BATCH = f"""CASE WHEN event_id % 45 = 0 THEN 0 WHEN event_id % 55 = 0 THEN {ENTITY_ID_MAX} ELSE entity_id END AS entity_id,
  CASE WHEN event_id % 65 = 0 THEN 91000000000 ELSE lat_nano END AS lat_nano, CASE WHEN event_id % 85 = 0 THEN -181000000000 ELSE lon_nano END AS lon_nano"""
_REST = ", ".join(c for c in COLUMNS if c not in ("entity_id", "lat_nano", "lon_nano"))
_OPS = f"SELECT {_REST}, {_BATCH}, event_id AS seq, CASE WHEN event_id % 35 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM g WHERE event_id % 5 = 0"


def _ops(spark: SparkSession, d: str, deletes: bool = True) -> tuple[DataFrame, DataFrame]:
    g = geo_events(spark, d)
    g.createOrReplaceTempView("driftmap_g")
    ops = spark.sql(_OPS.replace("FROM g", "FROM driftmap_g"))
    return latest(g.filter("event_id % 5 <> 0")), ops if deletes else ops.filter("op = 'upsert'")


_WRITE = f"""{_G}, state AS ({_LATEST.format("(SELECT * FROM g WHERE event_id % 5 <> 0)")}), ops AS ({_OPS}),
 u AS (SELECT *, CASE WHEN op = 'delete' THEN 0 WHEN entity_id = 0 THEN 7 WHEN entity_id = {ENTITY_ID_MAX} THEN 16 WHEN abs(lat_nano) > 90000000000 THEN 9
   WHEN abs(lon_nano) > 180000000000 THEN 10 WHEN heading_cdeg > 36000 THEN 14 ELSE 0 END AS own FROM ops
   UNION ALL BY NAME SELECT *, -1 AS seq, 'state' AS op, 0 AS own FROM state WHERE (flags & 32) = 0),
 e AS (SELECT *, coalesce(sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM u),
 m AS (SELECT *, max(CASE WHEN op <> 'delete' AND own = 0 THEN ts_ns END) OVER (PARTITION BY entity_id, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e),
 c AS (SELECT *, CASE WHEN op = 'delete' THEN CASE WHEN entity_id = 0 THEN 2 WHEN entity_id = {ENTITY_ID_MAX} THEN 4 WHEN top IS NOT NULL THEN 0 ELSE 3 END
   WHEN own <> 0 THEN own WHEN top IS NULL OR ts_ns > top THEN 0 ELSE 13 END AS code FROM m WHERE op <> 'state')"""


@query("write_codes", f"{_WRITE} SELECT seq, entity_id, op, code FROM c")
def _(spark, d):
    state, ops = _ops(spark, d)
    return writes.decide(state, ops, block=512).select("seq", "entity_id", "op", "code")


@query("write_state", f"""{_WRITE}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) AS _r FROM c WHERE code = 0) WHERE _r = 1)
 SELECT {_ALL} FROM state WHERE entity_id NOT IN (SELECT entity_id FROM w)
 UNION ALL BY NAME SELECT {", ".join(x for x in COLUMNS if x not in ("flags", "ttl_seconds", "ts_ns"))}, CASE WHEN op = 'delete' THEN flags | 32 ELSE flags END AS flags,
   CASE WHEN op = 'delete' THEN 0 ELSE ttl_seconds END AS ttl_seconds, CASE WHEN op = 'delete' THEN {AS_OF} + seq ELSE ts_ns END AS ts_ns FROM w""")  # fmt: skip
def _(spark, d):
    state, ops = _ops(spark, d)
    return writes.apply(state, writes.decide(state, ops, block=512), AS_OF)


@query("insert_events", f"{_WRITE.replace(_OPS, _OPS + chr(32) + 'AND event_id % 35 <> 0')} SELECT seq, entity_id, code FROM c")
def _(spark, d):
    state, ops = _ops(spark, d, deletes=False)
    return writes.insert_events(state, ops.drop("op"), AS_OF)[0]


#: Requests for every entity of the table, some twice, an unknown one and a reserved one.
_ASKED = f"SELECT DISTINCT entity_id, 0 AS again FROM {{0}} UNION ALL SELECT DISTINCT entity_id, 1 AS again FROM {{0}} WHERE entity_id % 3 = 0 UNION ALL SELECT {2**62}, 0 UNION ALL SELECT {ENTITY_ID_MAX}, 0"


@query("delete_entities", f"{_L}, ids AS (SELECT entity_id, CASE WHEN entity_id >= {2**62} THEN entity_id % 10 - 10 ELSE entity_id * 2 + again END AS seq FROM ({_ASKED.format('g')})) SELECT seq, ids.entity_id, CASE WHEN ids.entity_id = 0 THEN 2 WHEN ids.entity_id = {ENTITY_ID_MAX} THEN 4 WHEN latest.entity_id IS NULL OR (latest.flags & 32) <> 0 OR row_number() OVER (PARTITION BY ids.entity_id ORDER BY seq) > 1 THEN 3 ELSE 0 END AS code FROM ids LEFT JOIN latest ON latest.entity_id = ids.entity_id")
def _(spark, d):
    geo_events(spark, d).createOrReplaceTempView("driftmap_g")
    ids = spark.sql(_ASKED.format("driftmap_g")).selectExpr("entity_id", f"CASE WHEN entity_id >= {2**62} THEN entity_id % 10 - 10 ELSE entity_id * 2 + again END AS seq")
    return writes.delete_entities(_state(spark, d), ids, AS_OF)[0]


def _each(spark: SparkSession, d: str) -> DataFrame:
    """A request for every entity of the table, and for an unknown one."""
    own = geo_events(spark, d).select("entity_id").distinct().selectExpr("entity_id", "entity_id * 1000 AS seconds")
    return own.unionByName(spark.createDataFrame([(2**62, 5)], "entity_id bigint, seconds bigint"))


_TTL = "{0}, asked AS (SELECT DISTINCT entity_id, entity_id * 1000 AS seconds FROM g UNION ALL SELECT 4611686018427387904, 5) SELECT asked.entity_id, CASE WHEN l.entity_id IS NULL THEN 1 ELSE 0 END AS code, l.ttl_seconds AS previous_ttl, CASE WHEN l.entity_id IS NOT NULL THEN {1} END AS new_ttl FROM asked LEFT JOIN (SELECT * FROM latest WHERE (flags & 32) = 0) l ON l.entity_id = asked.entity_id"
for _how, _new in (("set", "asked.seconds"), ("extend", "least(l.ttl_seconds + asked.seconds, 4294967295)"), ("clear", "0")):
    query(f"ttl_{_how}", _TTL.format(_L, _new))(
        lambda spark, d, how=_how: writes.change_ttl(_state(spark, d), _each(spark, d), how)
    )


@query("cleanup_expired", f"{_L} SELECT count(*) AS entries_scanned, count(*) FILTER ({ttl.expired_sql(AS_OF, 'cleanup')}) AS entries_removed FROM latest")
def _(spark, d):
    return writes.cleanup_expired(_state(spark, d), AS_OF)[0]


@query("compact", f"{_L} SELECT * FROM latest WHERE (flags & 32) = 0 AND NOT {ttl.expired_sql(AS_OF, 'cleanup')}")
def _(spark, d):
    return writes.compact(geo_events(spark, d), AS_OF)


@query("ttl_cliffs", f"{_L}, b AS (SELECT CAST(least((ts_ns + ttl_seconds * {NANO} - {AS_OF}) // {3600 * NANO}, 23) AS BIGINT) AS bucket, count(*) AS n FROM latest WHERE ttl_seconds > 0 AND ts_ns + ttl_seconds * {NANO} > {AS_OF} GROUP BY 1) SELECT bucket, n, round(n / (SELECT sum(n) / 24.0 FROM b), 6) AS severity FROM b WHERE n / (SELECT sum(n) / 24.0 FROM b) > 1.2")
def _(spark, d):
    return cliffs.cliffs(_state(spark, d), AS_OF, 1.2)


# --- transforms, validation, change detection, privacy ---------------------------------


@query("transform_units", f"{_G} SELECT event_id, CAST(trunc(altitude_mm * 3.28084::DOUBLE) AS BIGINT) AS altitude_mm, CAST(trunc(accuracy_mm * 3.28084::DOUBLE) AS BIGINT) AS accuracy_mm, CAST(trunc(velocity_mms * 3.6::DOUBLE) AS BIGINT) AS velocity_mms FROM g")
def _(spark, d):
    g = transforms.convert_units(transforms.convert_units(geo_events(spark, d), "meters_to_feet"), "mps_to_kmh", "velocity")
    return g.select("event_id", "altitude_mm", "accuracy_mm", "velocity_mms")


@query("transform_pipeline", f"""{_G}, a AS (SELECT * REPLACE (CASE WHEN altitude_mm = 0 THEN 1500 ELSE altitude_mm END AS altitude_mm, least(30000, velocity_mms) AS velocity_mms,
  CASE WHEN heading_cdeg > 36000 THEN heading_cdeg % 36001 ELSE heading_cdeg END AS heading_cdeg, ts_ns + 3600000000000 AS ts_ns, (flags | 2) & ~4 AS flags) FROM g WHERE velocity_mms / 1000.0 >= 2.5)
  SELECT * REPLACE (CAST(trunc(altitude_mm * 2.0::DOUBLE) AS BIGINT) AS altitude_mm) FROM a WHERE altitude_mm / 1000.0 BETWEEN -20 AND 90""")  # fmt: skip
def _(spark, d):
    S = transforms.Step
    steps = (
        S("filter", ("velocity", "gte", 2.5), True), S("default", ("altitude", 1500)), S("clamp", ("velocity", 0, 30_000)), S("clamp", ("heading", 0, 0)),
        S("shift", (3600 * NANO,)), S("flag", ("imported", True)), S("flag", ("stationary", False)), S("filter", ("altitude", "in_range", -20, 90), True), S("math", ("altitude", "multiply", 2.0)),
    )
    return transforms.Pipeline(steps).run(geo_events(spark, d))


@query("transform_statistics", f"{_G} SELECT count(*) AS total, count(*) FILTER (velocity_mms / 1000.0 > 10 AND heading_cdeg / 100.0 < 300) AS succeeded, count(*) FILTER (velocity_mms / 1000.0 > 10 AND NOT heading_cdeg / 100.0 < 300) AS failed, count(*) FILTER (NOT velocity_mms / 1000.0 > 10) AS filtered FROM g")
def _(spark, d):
    S = transforms.Step
    return transforms.Pipeline((S("filter", ("velocity", "gt", 10), True), S("filter", ("heading", "lt", 300))), continue_on_error=False).statistics(geo_events(spark, d))


def _offset_sql(lat: str, lon: str) -> tuple[str, str]:
    """The shifted latitude and longitude of the Chinese datum, in degrees, as SQL text."""
    pi, (south, top, west, right) = math.pi, geo.CHINA
    x, y = f"({lon} - 105.0::DOUBLE)", f"({lat} - 35.0::DOUBLE)"
    num = lambda v: f"{v!r}::DOUBLE"
    waves = lambda v, *terms: "((" + " + ".join(f"{num(a)} * sin({v} * {num(f * pi)})" for a, f in terms) + ") * 2.0::DOUBLE / 3.0::DOUBLE)"
    common, root = waves(x, (20.0, 6.0), (20.0, 2.0)), f"sqrt(abs({x}))"
    north = f"(-100.0::DOUBLE + 2.0::DOUBLE * {x} + 3.0::DOUBLE * {y} + 0.2::DOUBLE * {y} * {y} + 0.1::DOUBLE * {x} * {y} + 0.2::DOUBLE * {root} + {common} + {waves(y, (20.0, 1.0), (40.0, 1 / 3))} + {waves(y, (160.0, 1 / 12), (320.0, 1 / 30))})"
    east = f"(300.0::DOUBLE + {x} + 2.0::DOUBLE * {y} + 0.1::DOUBLE * {x} * {x} + 0.1::DOUBLE * {x} * {y} + 0.1::DOUBLE * {root} + {common} + {waves(x, (20.0, 1.0), (40.0, 1 / 3))} + {waves(x, (150.0, 1 / 12), (300.0, 1 / 30))})"
    phi = f"({lat} * {num(pi)} / 180)"
    magic = f"(1 - {num(geo.GCJ_EE)} * sin({phi}) * sin({phi}))"
    inside = f"{lon} > {west}::DOUBLE AND {lon} < {right}::DOUBLE AND {lat} > {south}::DOUBLE AND {lat} < {top}::DOUBLE"
    d_lat = f"{north} * 180.0::DOUBLE / ({num(geo.GCJ_A * (1 - geo.GCJ_EE))} / ({magic} * sqrt({magic})) * {num(pi)})"
    d_lon = f"{east} * 180.0::DOUBLE / ({num(geo.GCJ_A)} / sqrt({magic}) * cos({phi}) * {num(pi)})"
    return f"CASE WHEN {inside} THEN {lat} + {d_lat} ELSE {lat} END", f"CASE WHEN {inside} THEN {lon} + {d_lon} ELSE {lon} END"


_MOVED = _offset_sql("lat", "lon")


@query("transform_coordinates", f"""{_G}, a AS (SELECT event_id, (lat_nano - 9000000000) / 1e9::DOUBLE AS lat, (lon_nano + 190000000000) / 1e9::DOUBLE AS lon FROM g),
  b AS (SELECT event_id, CAST(trunc(({_MOVED[0]}) * 1e9::DOUBLE) AS BIGINT) AS la, CAST(trunc(({_MOVED[1]}) * 1e9::DOUBLE) AS BIGINT) AS lo FROM a),
  c AS (SELECT event_id, la, lo, la / 1e9::DOUBLE AS lat, lo / 1e9::DOUBLE AS lon FROM b),
  e AS (SELECT event_id, la, lo, CAST(trunc((lat * 2 - ({_MOVED[0]})) * 1e9::DOUBLE) AS BIGINT) AS back FROM c)
  SELECT event_id, CAST(round(la / 1000::DOUBLE) AS BIGINT) AS lat_micro, CAST(round(lo / 1000::DOUBLE) AS BIGINT) AS lon_micro, CAST(round((back - la) / 1e4::DOUBLE) AS BIGINT) AS shift FROM e""")  # fmt: skip
def _(spark, d):
    """Moved into the box of the Chinese datum, then shifted and back; whole metres of error."""
    g = geo_events(spark, d).selectExpr("event_id", "lat_nano - 9000000000 AS lat_nano", "lon_nano + 190000000000 AS lon_nano")
    there = transforms.convert_coordinates(g, "wgs84_to_gcj02")
    back = transforms.convert_coordinates(there.withColumnsRenamed({"lat_nano": "a", "lon_nano": "b"}).withColumns({"lat_nano": F.col("a"), "lon_nano": F.col("b")}), "gcj02_to_wgs84")
    return back.select("event_id", F.round(F.col("a") / 1000).cast("long").alias("lat_micro"), F.round(F.col("b") / 1000).cast("long").alias("lon_micro"), F.round((F.col("lat_nano") - F.col("a")) / 1e4).cast("long").alias("shift"))


_WINDOWS = "SELECT *, lag(ts_ns) OVER (PARTITION BY entity_id ORDER BY event_id) AS _last, row_number() OVER (PARTITION BY entity_id, ts_ns ORDER BY event_id) AS _copy FROM g"


@query("validate_events", f"""{_G}, w AS ({_WINDOWS}) SELECT event_id, NOT (entity_id = 0 OR event_id = 0 OR heading_cdeg > 36000) AS is_valid,
  concat_ws(',', CASE WHEN entity_id <> 0 AND ts_ns < _last THEN 'timestamp_ordering' END, CASE WHEN entity_id = 0 THEN 'entity_id_format' END, CASE WHEN entity_id <> 0 AND _copy > 1 THEN 'entity_id_duplicate' END,
  CASE WHEN event_id = 0 THEN 'required_field' END, CASE WHEN heading_cdeg > 36000 THEN 'heading_range' END, CASE WHEN ttl_seconds > 200000 THEN 'ttl_exceeded' END, CASE WHEN (flags & 33) = 33 THEN 'business_rule' END) AS issues FROM w""")  # fmt: skip
def _(spark, d):
    checked = validation.validate(geo_events(spark, d), validation.Options(ordering=True, uniqueness=True, max_ttl=200_000))
    return checked.select("event_id", "is_valid", F.array_join(F.transform("issues", lambda x: x["category"]), ",").alias("issues"))


_HAS = ", ".join(f"count(*) FILTER ({c} <> 0) AS has_{s}" for c, s in zip(validation.OPTIONAL, validation.SHORT, strict=True))
_SUM = " + ".join(f"count(*) FILTER ({c} <> 0)" for c in validation.OPTIONAL)
_FLAG = ", ".join(f"count(*) FILTER ((flags & {1 << b}) <> 0) AS {n}_count" for n, b in validation.FLAGS.items())


@query("data_profile", f"""{_G} SELECT count(*) AS total_events, count(*) FILTER (NOT (entity_id = 0 OR event_id = 0 OR heading_cdeg > 36000)) AS valid_events, 0 AS warning_events,
  min(lat_nano) AS min_lat_nano, max(lat_nano) AS max_lat_nano, min(lon_nano) AS min_lon_nano, max(lon_nano) AS max_lon_nano, min(ts_ns) FILTER (ts_ns <> 0) AS min_ts_ns, max(ts_ns) AS max_ts_ns,
  count(*) FILTER (ts_ns = 0) AS zero_timestamp_count, count(*) FILTER (entity_id = 0) AS zero_entity_count, {_HAS}, {_FLAG},
  0 AS coord_errors, 0 AS timestamp_errors, count(*) FILTER (entity_id = 0) AS entity_id_errors, count(*) FILTER (event_id = 0) AS required_field_errors, count(*) FILTER (heading_cdeg > 36000) AS heading_errors,
  0 AS ttl_errors, 0 AS flag_errors, count(DISTINCT entity_id) FILTER (entity_id <> 0) AS unique_entity_count, count(*) FILTER (entity_id <> 0) - count(DISTINCT entity_id) FILTER (entity_id <> 0) AS duplicate_entity_count,
  count(*) FILTER (entity_id = 0 OR event_id = 0 OR heading_cdeg > 36000) AS invalid_events, round(({_SUM}) * 100.0::DOUBLE / (8 * count(*)), 6) AS completeness_percent,
  round(count(*) FILTER (NOT (entity_id = 0 OR event_id = 0 OR heading_cdeg > 36000)) * 100.0::DOUBLE / count(*), 6) AS success_percent, max(ts_ns) // {NANO} - min(ts_ns) FILTER (ts_ns <> 0) // {NANO} AS span_seconds FROM g""")  # fmt: skip
def _(spark, d):
    return validation.profile(geo_events(spark, d))


#: The last sync; the target has most entities' events up to four days after it, the source all
#: events from two days before it, some moved, and all of every seventh entity: together all events.
_SYNC = AS_OF - 8 * 86400 * NANO
_SOURCE = f"(ts_ns >= {_SYNC - 2 * 86400 * NANO} OR entity_id % 7 = 3)"
_TARGET = f"(ts_ns < {_SYNC + 4 * 86400 * NANO} AND entity_id % 7 <> 3)"


def _load(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = geo_events(spark, d)
    source = g.filter(_SOURCE).withColumn("altitude_mm", F.when(F.col("event_id") % 2 == 0, 0).otherwise(F.col("altitude_mm")))
    return source, g.filter(_TARGET)


_INC = f"""{_G}, s AS (SELECT * REPLACE (CASE WHEN event_id % 2 = 0 THEN 0 ELSE altitude_mm END AS altitude_mm) FROM g WHERE {_SOURCE} AND ts_ns >= {_SYNC}),
  t AS (SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_id DESC) AS _r FROM g WHERE {_TARGET}) WHERE _r = 1),
  j AS (SELECT s.*, t.entity_id IS NULL AS fresh, t.entity_id IS NOT NULL AND t.ts_ns > {_SYNC} AND s.ts_ns > {_SYNC} AS conflict,
    {" OR ".join(f"s.{c} IS DISTINCT FROM t.{c}" for c in incremental.COMPARED)} AS differs, {", ".join(f"t.{c} AS t_{c}" for c in COLUMNS)} FROM s LEFT JOIN t ON t.entity_id = s.entity_id)"""


def _incremental(policy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        source, target = _load(spark, d)
        out = incremental.changes(source, target, _SYNC, policy)
        return out.select("operation", "entity_id", "ts_ns", "had_conflict", F.col("event.event_id").alias("event_id"), F.col("event.altitude_mm").alias("altitude_mm"), F.col("event.ts_ns").alias("event_ts"), F.col("previous.event_id").alias("previous_id"))

    return run


_PICK = {
    "source_wins": ("event_id", "altitude_mm", "ts_ns"),
    "target_wins": ("t_event_id", "t_altitude_mm", "t_ts_ns"),
    "latest_wins": tuple(f"CASE WHEN ts_ns >= t_ts_ns THEN {c} ELSE t_{c} END" for c in ("event_id", "altitude_mm", "ts_ns")),
    "merge_source_priority": ("event_id", "CASE WHEN altitude_mm = 0 THEN t_altitude_mm ELSE altitude_mm END", "greatest(ts_ns, t_ts_ns)"),
    "merge_target_priority": ("t_event_id", "CASE WHEN t_altitude_mm = 0 THEN altitude_mm ELSE t_altitude_mm END", "greatest(ts_ns, t_ts_ns)"),
    "reject": ("NULL", "NULL", "NULL"),
}
for _policy, _p in _PICK.items():
    _op = "CASE WHEN fresh THEN 'insert' WHEN conflict THEN 'conflict' ELSE 'update' END" if _policy == "reject" else "CASE WHEN fresh THEN 'insert' ELSE 'update' END"
    _cols = ", ".join(f"CASE WHEN conflict THEN {x} ELSE {c} END AS {n}" for x, c, n in zip(_p, ("event_id", "altitude_mm", "ts_ns"), ("event_id", "altitude_mm", "event_ts"), strict=True))
    query(f"incremental_{_policy}", f"{_INC} SELECT {_op} AS operation, entity_id, ts_ns, conflict AS had_conflict, {_cols}, t_event_id AS previous_id FROM j WHERE fresh OR differs")(_incremental(_policy))


@query("incremental_load", f"""{_INC}, w AS (SELECT entity_id, CASE WHEN conflict AND ts_ns < t_ts_ns THEN t_event_id ELSE event_id END AS event_id, ts_ns FROM j WHERE fresh OR differs),
  x AS (SELECT entity_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts_ns DESC, event_id DESC) AS _r FROM w) WHERE _r = 1)
  SELECT entity_id, event_id FROM (SELECT * FROM ({_LATEST.format(f"(SELECT * FROM g WHERE {_TARGET})")})) l WHERE entity_id NOT IN (SELECT entity_id FROM x) UNION ALL BY NAME SELECT entity_id, event_id FROM x""")  # fmt: skip
def _(spark, d):
    source, target = _load(spark, d)
    return incremental.load(latest(target), incremental.changes(source, target, _SYNC)).select("entity_id", "event_id")


@query("incremental_statistics", f"{_INC} SELECT count(*) FILTER (fresh) AS inserts, count(*) FILTER (NOT fresh AND differs) AS updates, 0 AS conflicts, count(*) FILTER ((fresh OR differs) AND conflict) AS had_conflict, (SELECT count(*) FROM g WHERE {_SOURCE}) AS source_events, (SELECT max(ts_ns) FROM g WHERE {_SOURCE}) AS checkpoint_ns FROM j")
def _(spark, d):
    source, target = _load(spark, d)
    return incremental.statistics(incremental.changes(source, target, _SYNC), source)


def _minimized(purpose: str) -> str:
    _, base, strip, most, enforce, *_ = minimize.PURPOSES[minimize.ORDER[purpose]]
    lv = f"greatest({minimize.RANK[base]}, CASE WHEN entity_id % 5 = 1 THEN entity_id % 8 ELSE 0 END, CASE WHEN entity_id % 5 = 1 AND entity_id % 2 = 0 THEN {minimize.CITY} ELSE 0 END)"
    pick = lambda i: "list_extract([" + ", ".join(str(x[i]) for x in minimize.LEVELS) + "], lv + 1)"
    ok = f"NOT (entity_id % 5 = 1 AND (((entity_id % 256) >> {minimize.ORDER[purpose]}) & 1) = 0)"
    child = "(entity_id % 5 = 1 AND entity_id % 2 = 0)"
    zero = lambda n, c: f"CASE WHEN ok AND NOT {str(n in strip).lower()}{' AND NOT ' + child if n in ('user_data', 'correlation_id') else ''} THEN {c} ELSE 0 END"
    rough = lambda c: f"CASE WHEN ok THEN CASE WHEN {c} < 0 THEN -1 ELSE 1 END * ((abs({c}) + {pick(1)} // 2) // {pick(1)} * {pick(1)}) ELSE {c} END AS {c}"
    bound = f"least({pick(3)}, {most})" if most else pick(3)
    keep = f"CASE WHEN ok AND (ttl_seconds = 0 OR ttl_seconds > {bound}) THEN {bound} ELSE ttl_seconds END" if enforce else "ttl_seconds"
    names = "list_extract([" + ", ".join(f"'{x[0]}'" for x in minimize.LEVELS) + "], CASE WHEN ok THEN lv + 1 ELSE 8 END)"
    return f"""{_G}, m AS (SELECT *, CAST({lv} AS INT) AS lv, {ok} AS ok FROM g) SELECT event_id, CASE WHEN ok THEN entity_id ELSE 0 END AS entity_id, {zero("correlation_id", "correlation_id")} AS correlation_id,
      {zero("user_data", "user_data")} AS user_data, ts_ns, {rough("lat_nano")}, {rough("lon_nano")}, CASE WHEN ok THEN group_id ELSE 0 END AS group_id, {zero("altitude", "altitude_mm")} AS altitude_mm,
      {zero("velocity", "velocity_mms")} AS velocity_mms, CASE WHEN ok THEN greatest({zero("accuracy", "accuracy_mm")}, {pick(2)} * 1000) ELSE 0 END AS accuracy_mm, {zero("heading", "heading_cdeg")} AS heading_cdeg,
      {keep} AS ttl_seconds, flags, {names} AS precision FROM m"""


def _minimize(purpose: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        g = geo_events(spark, d)
        own = g.select("entity_id").distinct().filter("entity_id % 5 = 1")
        settings = own.selectExpr("entity_id", "entity_id % 256 AS allowed_purposes", "CAST(entity_id % 8 AS INT) AS min_level", "entity_id % 2 = 0 AS is_child")
        return minimize.minimize(g, purpose, settings)

    return run


for _name, *_ in minimize.PURPOSES:
    query(f"minimize_{_name}", _minimized(_name))(_minimize(_name))


@query("reduce_precision", f"{_G} SELECT event_id, CASE WHEN lat_nano < 0 THEN -1 ELSE 1 END * ((abs(lat_nano) + 45000) // 90000 * 90000) AS lat_nano, CASE WHEN lon_nano < 0 THEN -1 ELSE 1 END * ((abs(lon_nano) + 45000) // 90000 * 90000) AS lon_nano FROM g")
def _(spark, d):
    return minimize.reduce_precision(geo_events(spark, d), "city").select("event_id", "lat_nano", "lon_nano")


@query("gdpr_access", f"{_G} SELECT * FROM g WHERE entity_id = 9")
def _(spark, d):
    return minimize.access(geo_events(spark, d), 9)


@query("gdpr_erase", f"{_G} SELECT * FROM g WHERE entity_id NOT IN (SELECT i * 3 FROM range(40) t(i))")
def _(spark, d):
    return minimize.erase(geo_events(spark, d), spark.range(40).selectExpr("id * 3 AS entity_id"))


@query("gdpr_restrict", f"{_G} SELECT * FROM g WHERE entity_id NOT IN (4, 5) AND (flags & 32) = 0")
def _(spark, d):
    return minimize.restrict(geo_events(spark, d), spark.createDataFrame([(4,), (5,)], "entity_id bigint"))


@query("gdpr_rectify", f"{_G} SELECT * REPLACE (CASE WHEN event_id < 50 THEN event_id * 1000 ELSE lat_nano END AS lat_nano) FROM g")
def _(spark, d):
    return minimize.rectify(geo_events(spark, d), spark.range(50).selectExpr("id AS event_id", "id * 1000 AS lat_nano"))


@query("consent_check", f"{_G} SELECT * FROM g WHERE entity_id % 3 = 1 AND entity_id % 2 = 0")
def _(spark, d):
    g = geo_events(spark, d)
    ids = g.select("entity_id").distinct().filter("entity_id % 3 = 1")
    return minimize.with_consent(g, ids.selectExpr("entity_id", "'analytics' AS purpose", "0L AS granted_ns", f"IF(entity_id % 2 = 0, NULL, {AS_OF}) AS withdrawn_ns"), "analytics", AS_OF)


_DAY = bulk.day_range(2024, 1, 15)


@query("bulk_export", f"{_G} SELECT * FROM g WHERE ts_ns >= {_DAY[0]} AND ts_ns < {_DAY[1] + 5 * 86400 * NANO} AND lat_nano BETWEEN 39500000000 AND 40500000000 AND lon_nano BETWEEN -74500000000 AND -73500000000 AND group_id IN (1, 2, 3) AND event_id > 500 AND (flags & 32) = 0 AND NOT {ttl.expired_sql(AS_OF, 'cleanup')}")
def _(spark, d):
    what = bulk.ExportFilter(_DAY[0], _DAY[1] + 5 * 86400 * NANO, (39.5, 40.5, -74.5, -73.5), groups=(1, 2, 3), after_event=500)
    return bulk.select(geo_events(spark, d), what, AS_OF)


@query("bulk_export_summary", f"{_G} SELECT count(*) AS exported, max(event_id) AS last_event_id, min(ts_ns) AS min_ts_ns, max(ts_ns) AS max_ts_ns FROM g WHERE (flags & 32) = 0 AND entity_id IN (1, 2, 3, 4)")
def _(spark, d):
    return bulk.summary(bulk.select(geo_events(spark, d), bulk.ExportFilter(entities=(1, 2, 3, 4), include_expired=True), AS_OF))


# --- exchange --------------------------------------------------------------------------

_HEX = "lpad(printf('%x', {0}), 32, '0')"
_OPTIONAL_JSON = " || ".join(f"CASE WHEN {c} <> 0 THEN ',\"{n}\":' || printf('%.{k}f', {c} / {unit}::DOUBLE) ELSE '' END" for n, c, unit, k in files.MEASURES)
_FLAGS_JSON = " || ',' || ".join(f"'\"{n}\":' || CASE WHEN (flags & {1 << b}) <> 0 THEN 'true' ELSE 'false' END" for n, b in validation.FLAGS.items())
_JSON = (
    f"""'{{"id":"' || {_HEX.format("event_id")} || '","entity_id":"' || {_HEX.format("entity_id")} || '"' || CASE WHEN correlation_id <> 0 THEN ',"correlation_id":"' || {_HEX.format("correlation_id")} || '"' ELSE '' END"""
    f""" || CASE WHEN user_data <> 0 THEN ',"user_data":"' || {_HEX.format("user_data")} || '"' ELSE '' END || ',"latitude":' || printf('%.9f', lat_nano / 1e9::DOUBLE) || ',"longitude":' || printf('%.9f', lon_nano / 1e9::DOUBLE)"""
    f""" || ',"timestamp_ns":' || ts_ns || ',"timestamp_ms":' || (ts_ns // 1000000) || ',"group_id":' || group_id || {_OPTIONAL_JSON} || CASE WHEN ttl_seconds <> 0 THEN ',"ttl_seconds":' || ttl_seconds ELSE '' END || ',"flags":{{' || {_FLAGS_JSON} || '}}}}'"""
)


@query("export_json", f"{_G} SELECT event_id, {_JSON} AS document FROM g")
def _(spark, d):
    return geo_events(spark, d).select("event_id", files.event_json().alias("document"))


@query("export_geojson", f"""{_G} SELECT event_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || printf('%.9f', lon_nano / 1e9::DOUBLE) || ',' || printf('%.9f', lat_nano / 1e9::DOUBLE) || ']}},"properties":' || {_JSON} || '}}' AS document FROM g""")
def _(spark, d):
    return geo_events(spark, d).select("event_id", files.geojson_feature().alias("document"))


@query("export_csv", f"""{_G} SELECT {_HEX.format("event_id")} AS id, {_HEX.format("entity_id")} AS entity_id, {_HEX.format("correlation_id")} AS correlation_id, printf('%.9f', lat_nano / 1e9::DOUBLE) AS latitude, printf('%.9f', lon_nano / 1e9::DOUBLE) AS longitude,
  strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp_ns, CAST(group_id AS VARCHAR) AS group_id, CAST(ttl_seconds AS VARCHAR) AS ttl_seconds, {", ".join(f"printf('%.{k}f', {c} / {unit}::DOUBLE) AS {n}" for n, c, unit, k in files.MEASURES)},
  {", ".join(f"CASE WHEN (flags & {1 << b}) <> 0 THEN '1' ELSE '0' END AS flag_{n}" for n, b in validation.FLAGS.items())} FROM g""")  # fmt: skip
def _(spark, d):
    return files.csv_rows(geo_events(spark, d), "iso8601")


@query("parse_ids", f"{_G} SELECT event_id, event_id AS from_hex, ts_ns // 1000000 * 1000000 AS from_iso FROM g")
def _(spark, d):
    g = geo_events(spark, d)
    iso = text.parse_time(text.iso_time(F.col("ts_ns")))
    return g.select("event_id", text.from_hex(F.concat(F.lit("0x"), text.hex32(F.col("event_id")))).alias("from_hex"), iso.alias("from_iso"))


@query("change_feed", f"""{_G}, a AS ({_LATEST.format(f"(SELECT * FROM g WHERE ts_ns < {_SYNC})")}), b AS ({_LATEST.format("g")})
  SELECT CASE WHEN a.entity_id IS NULL THEN 'INSERT' WHEN b.entity_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS change_type, coalesce(b.entity_id, a.entity_id) AS entity_id, coalesce(b.event_id, a.event_id) AS event_id
  FROM (SELECT * FROM a WHERE (flags & 32) = 0) a FULL JOIN (SELECT * FROM b WHERE (flags & 32) = 0) b ON a.entity_id = b.entity_id WHERE a.event_id IS DISTINCT FROM b.event_id""")  # fmt: skip
def _(spark, d):
    g = geo_events(spark, d)
    return cdc.changes(latest(g.filter(F.col("ts_ns") < _SYNC)), latest(g), AS_OF).select("change_type", "entity_id", "event_id")


@query("change_envelopes", f"""{_G}, a AS ({_LATEST.format(f"(SELECT * FROM g WHERE ts_ns < {_SYNC})")}), b AS ({_LATEST.format("g")}),
  c AS (SELECT CASE WHEN a.entity_id IS NULL THEN 'INSERT' WHEN b.entity_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS change_type, {", ".join(f"coalesce(b.{c}, a.{c}) AS {c}" for c in COLUMNS)}
    FROM (SELECT * FROM a WHERE (flags & 32) = 0) a FULL JOIN (SELECT * FROM b WHERE (flags & 32) = 0) b ON a.entity_id = b.entity_id WHERE a.event_id IS DISTINCT FROM b.event_id),
  n AS (SELECT *, row_number() OVER (ORDER BY ts_ns, entity_id) AS sequence FROM c)
  SELECT sequence, 'geo.events.' || lower(change_type) AS routing_key, '{{"sequence":' || sequence || ',"commit_timestamp":{AS_OF},"change_type":"' || change_type || '","event":' || {_JSON} || '}}' AS document FROM n""")  # fmt: skip
def _(spark, d):
    g = geo_events(spark, d)
    return cdc.envelopes(cdc.numbered(cdc.changes(latest(g.filter(F.col("ts_ns") < _SYNC)), latest(g), AS_OF), 1))
