"""Cases of reads, writes and expiry through the engine, in client units."""

import pytest
from pyspark.sql import functions as F

from driftmap.functions import geo
from driftmap.model import ENTITY_ID_MAX, NANO, QueryStatus, to_nano
from driftmap.plans.console import ConsoleError, parse
from driftmap.plans.engine import Engine, Query
from driftmap.plans.prepared import PreparedError, Registry

T0 = 1_700_000_000 * NANO


def event(entity_id, lat=40.0, lon=-74.0, **more):
    return {"entity_id": entity_id, "latitude": lat, "longitude": lon} | more


def engine(spark, *rows):
    e = Engine(spark)
    if rows:
        e.insert(list(rows), T0)
    return e


def codes(df):
    return [r["code"] for r in df.orderBy("seq").collect()]


def ids(result):
    return [r["entity_id"] for r in result.df.collect()]


def test_insert_codes(spark):
    e = Engine(spark)
    rows = [event(0), event(ENTITY_ID_MAX), event(1, lat=90.1), event(2, lon=-180.5), event(3, heading=360.01), event(4), event(5, 90, 180), event(6, -90, -180), event(7, 0, 0)]
    assert codes(e.insert(rows, T0)) == [7, 16, 9, 10, 14, 0, 0, 0, 0]
    assert e.state.count() == 4


def test_later_wins_and_late_is_refused(spark):
    e = Engine(spark)
    rows = [event(1, timestamp=T0), event(1, 41.0, timestamp=T0 + 5), event(1, 42.0, timestamp=T0 + 3), event(1, timestamp=T0 + 5)]
    assert codes(e.insert(rows, T0)) == [0, 0, 13, 13]
    assert [r["lat_nano"] for r in e.state.collect()] == [to_nano(41.0)]


def test_server_times_follow_arrival(spark):
    e = engine(spark, event(1), event(2), event(3))
    assert sorted((r["entity_id"], r["ts_ns"]) for r in e.state.collect()) == [(1, T0 - 2), (2, T0 - 1), (3, T0)]


def test_default_ttl(spark):
    e = Engine(spark, default_ttl=60)
    e.insert([event(1), event(2, ttl_seconds=5)], T0)
    assert {r["entity_id"]: r["ttl_seconds"] for r in e.state.collect()} == {1: 60, 2: 5}


def test_delete_and_revive(spark):
    e = engine(spark, event(1, timestamp=T0), event(2, timestamp=T0))
    assert codes(e.delete([1, 99, 0, ENTITY_ID_MAX, 1], T0 + 9)) == [0, 3, 2, 4, 3]
    assert e.run(Query("uuid", {"entity_id": 1}), T0).df.first()["status"] == QueryStatus.ENTITY_NOT_FOUND
    assert codes(e.insert([event(1, timestamp=T0 - 50)], T0)) == [0]  # even an older event
    assert e.run(Query("uuid", {"entity_id": 1}), T0).df.first()["ts_ns"] == T0 - 50


def test_deletes_inside_a_batch(spark):
    from driftmap.operators import writes

    e = Engine(spark)
    rows = e.events([event(1, timestamp=9), event(1, timestamp=5), event(1), event(1, timestamp=5), event(1, timestamp=4)])
    rows = rows.withColumn("op", F.when(F.col("seq") == 2, "delete").otherwise("upsert"))
    for block in (1, 2, 100):
        got = writes.decide(e.state, rows, block).orderBy("seq").collect()
        assert [r["code"] for r in got] == [0, 13, 0, 0, 13]


def test_uuid_status_and_expiry(spark):
    e = engine(spark, event(1, timestamp=T0, ttl_seconds=10), event(2, timestamp=T0))
    at = lambda s: e.run(Query("uuid", {"entity_id": 1}), T0 + s * NANO).df.first()["status"]
    assert [at(9), at(10), at(11)] == [0, 0, QueryStatus.ENTITY_EXPIRED]  # strictly after whole seconds
    assert [r["entries_removed"] for r in e.cleanup_expired(T0 + 10 * NANO).collect()] == [1]  # at the moment itself
    assert e.run(Query("uuid", {"entity_id": 1}), T0).df.first()["status"] == QueryStatus.ENTITY_NOT_FOUND
    with pytest.raises(ValueError):
        e.run(Query("uuid", {"entity_id": 0}), T0)


def test_uuid_batch_keeps_order(spark):
    e = engine(spark, event(50101), event(50103))
    rows = e.run(Query("uuid_batch", {"entity_ids": [50101, 50102, 50103, 50104]}), T0).df.orderBy("position").collect()
    assert [r["found"] for r in rows] == [True, False, True, False] and rows[2]["entity_id"] == 50103


def test_radius_across_the_antimeridian_and_at_the_pole(spark):
    e = engine(spark, event(1, 0, 179.9), event(2, 0, -179.9), event(3, 0, 179.0), event(4, 89.9, 0), event(5, 89.95, 90), event(6, 89.0, 0))
    near = lambda lat, lon: sorted(ids(e.run(Query("radius", {"latitude": lat, "longitude": lon, "radius_m": 50_000}), T0)))
    assert near(0, 180) == [1, 2] and near(90, 0) == [4, 5]


def test_radius_edges_by_semantics(spark):
    e = engine(spark, event(1, 40.0 + 999 / 111_194.93), event(2, 40.0 + 990 / 111_194.93))
    asked = {"latitude": 40.0, "longitude": -74.0, "radius_m": 1000}
    assert sorted(ids(e.run(Query("radius", asked), T0))) == [1, 2]
    assert ids(e.run(Query("radius", asked | {"semantics": "reference"}), T0)) == [2]


def test_radius_time_window_and_group(spark):
    e = engine(spark, *[event(60800 + i, timestamp=i * 1000, group_id=i) for i in (1, 2, 3)])
    asked = {"latitude": 40.0, "longitude": -74.0, "radius_m": 10}
    assert ids(e.run(Query("radius", asked | {"ts_min": 1500, "ts_max": 2500}), T0)) == [60802]
    assert ids(e.run(Query("radius", asked | {"group_id": 3}), T0)) == [60803]


def test_limits_and_more(spark):
    e = engine(spark, *[event(i, 40 + i / 1000) for i in range(1, 6)])
    two = e.run(Query("radius", {"latitude": 40.0, "longitude": -74.0, "radius_m": 9_000, "limit": 2}), T0)
    assert ids(two) == [1, 2] and two.has_more
    all_ = e.run(Query("radius", {"latitude": 40.0, "longitude": -74.0, "radius_m": 9_000, "limit": 5}), T0)
    assert len(ids(all_)) == 5 and not all_.has_more
    for bad in (0, -1, 90_000):
        with pytest.raises(ValueError):
            e.run(Query("latest", {"limit": bad}), T0)


def test_polygons(spark):
    e = engine(spark, event(70001, 40.76, -74.01), event(70002, 40.75, -74.005), event(70003, 40.79, -74.0), event(70301, 40.745, -74.005), event(70302, 40.76, -74.01), event(70303, 40.759, -73.995))
    inside = lambda ring, **k: sorted(ids(e.run(Query("polygon", {"vertices": ring} | k), T0)))
    triangle = [(40.74, -74.02), (40.78, -74.02), (40.76, -73.98)]
    assert {70001, 70002} <= set(inside(triangle)) and 70003 not in inside(triangle)
    notched = [(40.74, -74.01), (40.76, -74.01), (40.755, -73.995), (40.76, -73.99), (40.74, -73.99)]
    got = inside(notched)
    assert 70301 in got and 70302 not in got and 70303 not in got
    hole = [(40.744, -74.006), (40.746, -74.006), (40.746, -74.004), (40.744, -74.004)]
    assert 70301 not in inside(notched, holes=[hole])


SQUARE = [(0, 0), (0, 10), (10, 10), (10, 0)]


def ring(points):
    return [(to_nano(a), to_nano(b)) for a, b in points]


@pytest.mark.parametrize(
    ("outer", "holes", "status"),
    [
        ([(0, 0), (1, 1)], [], QueryStatus.INVALID),
        ([(0, 0), (1, 1), (2, 2), (3, 3)], [], QueryStatus.POLYGON_DEGENERATE),
        ([(0, 0), (10, 10), (0, 10), (10, 0)], [], QueryStatus.POLYGON_SELF_INTERSECTING),
        ([(-1, 179), (-1, -179), (1, -179), (1, 179)], [], QueryStatus.POLYGON_TOO_LARGE),
        (SQUARE, [[(1, 1), (2, 2)]], QueryStatus.HOLE_VERTEX_COUNT),
        (SQUARE, [[(9, 9), (9, 12), (8, 9)]], QueryStatus.HOLE_NOT_CONTAINED),
        (SQUARE, [[(1, 1), (1, 3), (3, 1)], [(2, 2), (2, 4), (4, 2)]], QueryStatus.HOLES_OVERLAP),
        (SQUARE, [[(1, 1), (1, 2), (2, 1)]] * 101, QueryStatus.TOO_MANY_HOLES),
    ],
)
def test_polygon_checks(outer, holes, status):
    with pytest.raises(geo.PolygonError) as e:
        geo.Polygon.of(ring(outer), [ring(h) for h in holes])
    assert e.value.status == status


def test_closed_rings_and_winding():
    a = geo.Polygon.of(ring([*SQUARE, SQUARE[0]]))
    b = geo.Polygon.of(ring(SQUARE[::-1]))
    assert len(a.outer) == 4 and geo.signed_area(a.outer) > 0 and geo.signed_area(b.outer) > 0


def test_polygon_across_the_antimeridian(spark):
    e = engine(spark, event(1, 0, 175), event(2, 0, -175), event(3, 0, 0))
    assert sorted(ids(e.run(Query("polygon", {"vertices": [(-5, 170), (-5, -170), (5, -170), (5, 170)]}), T0))) == [1, 2]


def test_column_and_driver_agree_on_many_edges(spark):
    import random

    rng = random.Random(2)
    points = ring([(rng.uniform(-2, 12), rng.uniform(-2, 12)) for _ in range(300)])
    zigzag = ring([(i / 10, 0 if i % 2 else 3) for i in range(101)] + [(10, 10), (0, 10)])
    df = spark.createDataFrame(points, "lat_nano bigint, lon_nano bigint")
    got = [r["i"] for r in df.select(geo.in_ring(zigzag, F.col("lat_nano"), F.col("lon_nano")).alias("i")).collect()]
    assert got == [geo.contains(zigzag, p) for p in points] and any(got)


def test_latest_order_group_cursor(spark):
    e = engine(spark, *[event(80200 + i, timestamp=T0 + i, group_id=100 + 100 * (i % 2 == 0)) for i in range(1, 6)])
    assert ids(e.run(Query("latest", {"group_id": 100}), T0)) == [80205, 80203, 80201]
    page = e.run(Query("latest", {"limit": 2}), T0)
    assert ids(page) == [80205, 80204] and page.has_more
    assert ids(e.run(Query("latest", {"limit": 2, "cursor_ts": T0 + 4}), T0)) == [80203, 80202]


def test_newest_row_decides(spark):
    """An older row never stands in for one that does not qualify."""
    e = Engine(spark, Engine(spark).events([event(1, 40.0, timestamp=10), event(1, 50.0, timestamp=20)]).drop("seq"))
    assert ids(e.run(Query("radius", {"latitude": 40.0, "longitude": -74.0, "radius_m": 1000}), T0)) == []


def test_ttl_changes(spark):
    e = engine(spark, event(1, ttl_seconds=1800), event(2))
    one = lambda how, i, s=0: tuple(e.ttl(how, i, s).first()[1:])
    assert one("extend", 1, 1800) == (0, 1800, 3600) and one("extend", 2, 2**32) == (0, 0, 2**32 - 1)
    assert one("set", 1, 7) == (0, 3600, 7) and one("clear", 1) == (0, 7, 0) and one("clear", 1) == (0, 0, 0)
    assert one("set", 99, 1) == (1, None, None)


def test_batch_goes_on_after_a_bad_query(spark):
    e = engine(spark, event(1), event(2, 41.0))
    rows, status = e.batch([Query("uuid", {"entity_id": 1}), Query("polygon", {"vertices": [(0, 0), (10, 10), (0, 10), (10, 0)]}), Query("radius", {"latitude": 99, "longitude": 0, "radius_m": 1}), Query("nothing"), Query("latest", {"limit": 5})], T0)
    assert status == [0, 109, 1, 1, 0]
    assert sorted((r["query_id"], r["entity_id"]) for r in rows.collect()) == [(0, 1), (4, 1), (4, 2)]


def test_prepared(spark):
    e = engine(spark, event(1), event(2, 41.0))
    slot = e.prepare("one", "UUID $1")
    e.prepare("near", "radius $1 $2 $3 limit 10")
    assert ids(e.execute("near", T0, 40.0, -74.0, 100)) == [1]
    assert e.execute(slot, T0, 2).df.first()["entity_id"] == 2
    for bad in (("one", "UUID $1"), ("p", "POLYGON $1"), ("q", "RADIUS $1")):
        with pytest.raises(PreparedError):
            e.prepare(*bad)
    with pytest.raises(PreparedError):
        e.execute("near", T0, 1.0)
    assert e.prepared.deallocate("one") == 1 and e.prepared.deallocate() == 1
    r = Registry()
    for i in range(32):
        r.prepare(str(i), "LATEST LIMIT $1")
    with pytest.raises(PreparedError):
        r.prepare("x", "LATEST")


def test_console(spark):
    e = engine(spark, event(1), event(255, 41.0))
    run = lambda line: [r["entity_id"] for r in e.query(line, T0).collect()]
    assert run("QUERY UUID 0xff") == [255] and run("query radius (40, -74) 1000 LIMIT 5;") == [1]
    assert run("QUERY POLYGON (39,-75) (39,-73) (40.5,-73) (40.5,-75) LIMIT 3") == [1]
    assert sorted(run("QUERY LATEST LIMIT 2")) == [1, 255] and run("QUERY LATEST 1 LIMIT 2") == [1]
    e.query("BEGIN", T0)
    assert e.query("INSERT 7 (10, 20) group_id 3 altitude_m 1.5", T0 + 1).first()["code"] == 0
    assert run("QUERY UUID 7") == [7]
    e.query("ROLLBACK", T0)
    assert run("QUERY UUID 7") == [None]
    assert e.query("DELETE 1", T0 + 2).first()["code"] == 0
    e.query("SET limit = 5", T0)
    assert e.query("SHOW ALL", T0).collect()[0]["value"] == "5" and e.query("DESCRIBE events", T0).count() == 14
    assert e.query("SHOW STATUS", T0).first()["live"] == 1
    for bad in ("QUERY RADIUS 5", "QUERY RADIUS (1,2) x", "QUERY POLYGON (1,2) (3,4)", "FLY", "", "QUERY UUID zz", "QUERY RADIUS (1,2) 5 LIMIT x"):
        with pytest.raises(ConsoleError):
            parse(bad)


def test_client_and_scatter(spark):
    from driftmap.plans import client

    a, b = (client.GeoClient(spark, lambda: T0) for _ in range(2))
    assert codes(a.insert_events([event(1, timestamp=10), event(2, timestamp=10)])) == [0, 0]
    assert codes(b.upsert_events([event(1, 40.001, timestamp=20)])) == [0]
    both, partial = client.query_radius_scatter([a, b], 40.0, -74.0, 5_000)
    assert [(r["entity_id"], r["ts_ns"]) for r in both.collect()] == [(1, 20), (2, 10)] and not partial
    b.engine.state = None
    with pytest.raises(Exception):  # noqa: B017
        client.query_radius_scatter([a, b], 40.0, -74.0, 5_000)
    some, partial = client.query_polygon_scatter([a, b], [(39, -75), (39, -73), (41, -73), (41, -75)], policy="best_effort")
    assert partial and some.count() == 2
    assert a.get_latest_by_uuid(2).first()["status"] == 0 and a.get_latest_batch([2, 5]).filter("found").count() == 1
    assert a.set_ttl(2, 5).first()["code"] == 0 and a.extend_ttl(2, 5).first()["new_ttl"] == 10 and a.clear_ttl(2).first()["new_ttl"] == 0
    assert a.ping() and a.get_topology()["partitions"] and a.get_status().first()["live"] == 2
    assert a.query_latest(1).has_more and codes(a.delete_entities([1])) == [0]
    for bad in ((91, 0, 5), (0, 0, 0), (0, 0, 5, 0)):
        with pytest.raises(ValueError):
            client.radius_query(*bad)
    with pytest.raises(ValueError):
        client.polygon_query([(0, 0), (1, 1)])


def test_empty_engine(spark):
    e = Engine(spark)
    assert e.run(Query("latest"), T0).df.count() == 0 and e.status(T0).first()["n_rows"] == 0
    assert e.run(Query("uuid", {"entity_id": 5}), T0).df.first()["status"] == 200
