"""Round trips of files, identifiers, times, geometry text, cells, shards and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmap.functions import s2, text
from driftmap.model import COLUMNS, EVENT_SCHEMA, geo_events, to_nano
from driftmap.operators import minimize, regions, transforms
from driftmap.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def events(spark):
    return geo_events(spark, SF).cache()


def rows(df, columns=COLUMNS):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


WITHOUT = [c for c in COLUMNS if c != "user_data"]


@pytest.mark.parametrize("delimiter", ["comma", "tab", "semicolon", "pipe"])
def test_csv(spark, events, tmp_path, delimiter):
    path = str(tmp_path / delimiter)
    files.write_csv(events, path, delimiter)
    assert rows(files.read_csv(spark, path, delimiter), WITHOUT) == rows(events, WITHOUT)


def test_csv_times_and_mapping(spark, events, tmp_path):
    path = str(tmp_path / "iso")
    files.csv_rows(events, "iso8601").withColumnRenamed("latitude", "y").write.option("header", True).csv(path)
    got = files.read_csv(spark, path, mapping={"latitude": "y"})
    want = events.withColumn("ts_ns", F.expr("ts_ns div 1000000 * 1000000"))
    assert rows(got, WITHOUT) == rows(want, WITHOUT)


def test_csv_malformed(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("entity_id,latitude,longitude,timestamp_ns\n0a,1.5,2.5,1700000000\nzz,1,2,3\n0b,91,0,5\n0c,x,0,5\n0d,1,1,2024-01-01T00:00:00Z\n")
    good = files.read_csv(spark, str(path)).orderBy("entity_id").collect()
    assert [(r["entity_id"], r["lat_nano"], r["ts_ns"]) for r in good] == [(10, 1_500_000_000, 1_700_000_000 * 10**9), (13, 10**9, 1_704_067_200 * 10**9)]
    assert files.read_csv(spark, str(path), skip_malformed=False).filter("malformed").count() == 3


def test_json_round_trips(spark, events, tmp_path):
    files.write_ndjson(events, str(tmp_path / "nd"))
    assert rows(files.read_ndjson(spark, str(tmp_path / "nd"))) == rows(events)
    for kind in ("json", "geojson"):
        files.write_documents(events, str(tmp_path / kind), kind, 300)
        docs = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / kind)).collect()]
        assert sum(d["count" if kind == "json" else "totalFeatures"] for d in docs) == events.count()
        assert rows(files.read_documents(spark, str(tmp_path / kind), kind)) == rows(events)


def test_geometry_text():
    outer, holes = text.polygon_from_wkt("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (1 1, 2 1, 2 2, 1 1))")
    assert outer == [(0, 0), (0, 10**10), (10**10, 10**10), (10**10, 0)] and len(holes[0]) == 3
    assert text.polygon_from_wkt(text.polygon_to_wkt(outer, holes)) == (outer, holes)
    assert text.polygon_from_geojson(text.polygon_to_geojson(outer, holes)) == (outer, holes)
    assert text.point_from_wkt(text.point_to_wkt((to_nano(1.5), to_nano(-2.25)))) == (1_500_000_000, -2_250_000_000)
    assert text.point_from_geojson('{"type":"Point","coordinates":[2.5,1.5]}') == (1_500_000_000, 2_500_000_000)
    for bad in ("POINT(200 0)", "POINT(1)", "LINESTRING(0 0, 1 1)"):
        with pytest.raises(ValueError):
            text.point_from_wkt(bad)
    bow = [(0, 0), (10, 10), (0, 10), (10, 0)]
    found = text.explain_polygon([(a * 10**9, b * 10**9) for a, b in bow])
    assert found[0]["edges"] == (0, 2) and found[0]["at"] == pytest.approx((5e9, 5e9))


def test_wkt_columns(spark):
    df = spark.createDataFrame([("POINT(2.5 1.5)",), ("point ( -1 0 )",), ("POINT(200 1)",), ("x",), (None,)], "w string")
    lat, lon = text.wkt_point_columns(F.col("w"))
    assert [tuple(r) for r in df.select(lat, lon).collect()] == [(1_500_000_000, 2_500_000_000), (0, -(10**9)), (None, None), (None, None), (None, None)]


def test_entity_ids():
    assert [text.parse_entity_id(x) for x in ("0xFF", "42", "ff")] == [255, 42, 255]
    with pytest.raises(ValueError):
        text.parse_entity_id("zz")


def test_event_keys(spark):
    key = s2.key_of(0xB000000000000001)
    df = spark.createDataFrame([(key, 255)], "k bigint, t bigint")
    assert df.select(text.event_key_hex(F.col("k"), F.col("t"))).first()[0] == "b000000000000001" + "00000000000000ff"


def test_cells():
    assert int(s2.cell_ids(np.array([0]), np.array([0]))[0]) == 0x1000000000000001
    rng = np.random.default_rng(1)
    lat, lon = rng.integers(-90 * 10**9, 90 * 10**9, 3000), rng.integers(-180 * 10**9, 180 * 10**9, 3000)
    ids = s2.cell_ids(lat, lon)
    back, _ = s2.centres(ids)
    assert abs(back - lat).max() < 1000
    for c in ids[:50].tolist():
        assert s2.is_valid(c) and s2.level(c) == 30
        for at in (0, 7, 29):
            p = s2.parent(c, at)
            low, high = s2.leaf_range(p)
            assert s2.level(p) == at and low <= c < high and c in range(low, high)
            assert at == 30 or any(s2.leaf_range(k)[0] <= c < s2.leaf_range(k)[1] for k in s2.children(p))
        near = s2.neighbours(s2.parent(c, 12))
        assert all(s2.parent(c, 12) in s2.neighbours(n) for n in near)


def test_cells_prune(spark, events):
    g = events.withColumn("cell_key", s2.cell_key(F.col("lat_nano"), F.col("lon_nano")))
    from driftmap.operators.reads import radius_filter

    circle = (40 * 10**9, -74 * 10**9, 20_000_000)
    assert g.filter(radius_filter(*circle, cells=True)).count() == g.filter(radius_filter(*circle)).count()
    parents = g.select("cell_key", s2.parent_key(F.col("cell_key"), 9).alias("p")).collect()
    assert all(s2.cell_of(r["p"]) == s2.parent(s2.cell_of(r["cell_key"]), 9) for r in parents)


def test_shards():
    keys = np.arange(1, 5000)
    eight, nine = regions.jump(regions.shard_keys(keys), 8), regions.jump(regions.shard_keys(keys), 9)
    assert ((eight == nine) | (nine == 8)).all() and 400 < (eight != nine).sum() < 700
    for strategy in ("modulo", "jump", "ring"):
        sizes = np.bincount(regions.shards_of(keys, 16, strategy), minlength=16)
        assert sizes.min() > 150 and len(sizes) == 16


def test_covering_shards():
    lat, lon = 40 * 10**9, -74 * 10**9
    own = int(regions.shards_of(s2.cell_ids(np.array([lat]), np.array([lon])), 16, "spatial")[0])
    assert own in regions.covering_shards(s2.cover_circle(lat, lon, 1_000_000), 16)
    assert regions.covering_shards(s2.cover_circle(lat, lon, 4_000_000_000), 16) == list(range(16))


def test_tiers(spark):
    h = 3600 * 10**9
    log = [(1, i * 10**9) for i in range(12)] + [(2, i * 10**9) for i in range(3)] + [(3, 0)] + [(4, i * 10**9) for i in range(12)] + [(5, i * h) for i in range(1, 20)]
    df = spark.createDataFrame(log, "entity_id bigint, ts_ns bigint")
    tier = lambda at: {r["entity_id"]: r["tier"] for r in regions.tiers(df, at).collect()}
    assert tier(20 * 10**9) == {1: "hot", 2: "hot", 3: "hot", 4: "hot", 5: "warm"}  # an insertion makes hot, hourly accesses are idle in between
    assert tier(2 * h)[1] == "warm" and tier(30 * h)[1] == "cold"
    day = 24 * h
    again = [(1, 0)] + [(1, 2 * day + i) for i in range(3)] + [(2, 0)] + [(2, 2 * day + i) for i in range(12)] + [(3, 0)] + [(3, 2 * day + i) for i in range(13)]
    later = {r["entity_id"]: (r["tier"], r["promotions"]) for r in regions.tiers(spark.createDataFrame(again, "entity_id bigint, ts_ns bigint"), 2 * day + 99).collect()}
    assert later == {1: ("warm", 1), 2: ("warm", 1), 3: ("hot", 2)}  # counting starts anew after a promotion
    capped = regions.tiers(df.filter("entity_id IN (1, 4)"), 20 * 10**9, regions.TierRules(max_hot=1)).collect()
    assert sorted(r["tier"] for r in capped) == ["hot", "warm"]


def test_transforms_of_coordinates(spark):
    df = spark.createDataFrame([(to_nano(39.9), to_nano(116.4)), (to_nano(10.0), to_nano(10.0))], "lat_nano bigint, lon_nano bigint")
    there = transforms.convert_coordinates(df, "wgs84_to_gcj02").collect()
    assert 0.001 < there[0]["lat_nano"] / 1e9 - 39.9 < 0.003 and 0.004 < there[0]["lon_nano"] / 1e9 - 116.4 < 0.008
    assert there[1]["lat_nano"] == to_nano(10.0)
    back = transforms.convert_coordinates(transforms.convert_coordinates(df, "gcj02_to_bd09"), "bd09_to_gcj02").collect()
    assert abs(back[0]["lat_nano"] - to_nano(39.9)) < 5_000


def test_noise_is_seeded_and_bounded(spark, events):
    a, b = (minimize.add_noise(events, 1000, 4).select("event_id", "lat_nano").collect() for _ in range(2))
    assert a == b
    far = events.join(minimize.add_noise(events, 1000, 4).selectExpr("event_id", "lat_nano AS m"), "event_id").agg(F.max(F.abs(F.col("m") - F.col("lat_nano")))).first()[0]
    assert 0 < far <= 9000


def test_live_positions_stream(spark, tmp_path):
    from driftmap.streaming.positions import merge_batches, positions, snapshot

    source = str(tmp_path / "in")
    base = dict.fromkeys(COLUMNS, 0)
    sec = 10**9

    def drop(name, *events):
        data = [tuple((base | e)[c] for c in COLUMNS) for e in events]
        spark.createDataFrame(data, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)

    drop("a", {"event_id": 1, "entity_id": 1, "ts_ns": 10 * sec}, {"event_id": 2, "entity_id": 2, "ts_ns": 10 * sec, "ttl_seconds": 5})
    stream = lambda: spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = merge_batches(stream(), str(tmp_path / "snap"), str(tmp_path / "c1"))
    q.awaitTermination(120)
    drop("b", {"event_id": 3, "entity_id": 1, "ts_ns": 5 * sec}, {"event_id": 4, "entity_id": 1, "ts_ns": 20 * sec})
    q = merge_batches(stream(), str(tmp_path / "snap"), str(tmp_path / "c1"))
    q.awaitTermination(120)
    held = lambda n=None: sorted((r["entity_id"], r["event_id"]) for r in snapshot(spark, str(tmp_path / "snap"), n).collect())
    assert held() == [(1, 4), (2, 2)] and held(0) == [(1, 1), (2, 2)]
    drop("b2", {"event_id": 5, "entity_id": 1, "ts_ns": 30 * sec, "flags": 32}, {"event_id": 6, "entity_id": 1, "ts_ns": 4 * sec})
    drop("b3", {"event_id": 7, "entity_id": 1, "ts_ns": 5 * sec})
    merge_batches(stream(), str(tmp_path / "snap"), str(tmp_path / "c1")).awaitTermination(120)
    assert held() == [(1, 7), (2, 2)] and held(2) == [(1, 6), (2, 2)]
    assert len(list((tmp_path / "snap").glob("bucket=*/*"))) == 3  # entity 1 in this and the version before, entity 2

    drop("c", {"event_id": 8, "entity_id": 3, "ts_ns": 5000 * sec, "user_data": None}, {"event_id": 9, "entity_id": 1, "ts_ns": 4000 * sec, "flags": 32})
    drop("d", {"event_id": 10, "entity_id": 3, "ts_ns": 5001 * sec})
    q = positions(stream(), "1 second").writeStream.format("memory").queryName("live_positions").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r["entity_id"], r["change"]) for r in spark.table("live_positions").collect()}
    assert {(1, "INSERT"), (2, "INSERT"), (2, "EXPIRE"), (1, "DELETE"), (3, "INSERT")} <= got


def test_change_feed_numbers(spark, events):
    from driftmap.operators.latest import latest
    from driftmap.streaming import cdc

    changed = cdc.numbered(cdc.changes(latest(events.limit(0)), latest(events), 5), 10)
    got = [r["sequence"] for r in changed.orderBy("ts_ns", "entity_id").collect()]
    assert got == list(range(10, 10 + len(got)))
    doc = json.loads(cdc.envelopes(changed).first()["document"])
    assert doc["change_type"] == "INSERT" and doc["commit_timestamp"] == 5 and "entity_id" in doc["event"]


def test_change_feed_numbers_are_dense(spark):
    from driftmap.streaming import cdc

    n = 500_000
    rows = spark.range(0, n, 1, 40).selectExpr("id AS entity_id", "(id * 7919) % 1000 AS ts_ns", "repeat('x', 50) AS more")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    got = cdc.numbered(rows, 1).agg(F.count("*"), F.countDistinct("sequence"), F.min("sequence"), F.max("sequence"), F.countDistinct("entity_id")).first()
    assert tuple(got) == (n, n, 1, n, n)
    order = cdc.numbered(rows.limit(5000)).orderBy("sequence").select("ts_ns", "entity_id").collect()
    assert order == sorted(order)


def walk(rows):
    """One by one, as they arrive."""
    held = {}
    for r in rows:
        now = held.get(r["entity_id"])
        if now and (r["ts_ns"], r["event_id"]) <= (now["ts_ns"], now["event_id"]):
            continue
        if r["flags"] & 32:
            held.pop(r["entity_id"], None)
        else:
            held[r["entity_id"]] = r
    return sorted((r["entity_id"], r["event_id"]) for r in held.values())


@pytest.mark.parametrize("cuts", [(), (1, 2), (30,), (7, 20, 41)])
def test_state_does_not_depend_on_batches(spark, cuts):
    import random

    from driftmap.operators.latest import replay

    rng = random.Random(5)
    base = dict.fromkeys(COLUMNS, 0)
    few = [{"entity_id": 1, "ts_ns": 10}, {"entity_id": 1, "ts_ns": 20, "flags": 32}, {"entity_id": 1, "ts_ns": 5}]
    few += [{"entity_id": rng.randint(1, 4), "ts_ns": rng.randint(0, 30), "flags": 32 * (rng.random() < 0.3)} for _ in range(60)]
    rows = [base | r | {"event_id": i} for i, r in enumerate(few)]
    state = spark.createDataFrame([], EVENT_SCHEMA)
    for a, b in zip((0, *cuts), (*cuts, len(rows)), strict=True):
        batch = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows[a:b]], EVENT_SCHEMA)
        state = spark.createDataFrame(replay(state, batch).collect(), EVENT_SCHEMA)
    assert sorted((r["entity_id"], r["event_id"]) for r in state.collect()) == walk(rows)


WIDE = "ffffffffffffffff0000000000000007"


def test_wide_ids_survive_every_format(spark, events, tmp_path):
    from driftmap.model import IDS, WIDE_SCHEMA

    wide = events.withColumns({c: F.concat(F.lit("ffffffffffffffff"), F.substring(text.hex32(F.col(c)), 17, 16)) for c in IDS})
    wide = wide.withColumn("user_data", F.when(F.col("ts_ns") % 2 == 0, "0" * 32).otherwise(F.col("user_data")))
    assert [f.dataType for f in wide.select(COLUMNS).schema] == [f.dataType for f in WIDE_SCHEMA]
    files.write_ndjson(wide, str(tmp_path / "nd"))
    assert rows(files.read_ndjson(spark, str(tmp_path / "nd"), wide=True)) == rows(wide)
    for kind in ("json", "geojson"):
        files.write_documents(wide, str(tmp_path / kind), kind, 300)
        assert rows(files.read_documents(spark, str(tmp_path / kind), kind, wide=True)) == rows(wide)
    files.write_csv(wide, str(tmp_path / "csv"))
    assert rows(files.read_csv(spark, str(tmp_path / "csv"), wide=True), WITHOUT) == rows(wide, WITHOUT)
    assert files.read_csv(spark, str(tmp_path / "csv")).count() == 0  # never cut to 64 bits
    assert files.read_csv(spark, str(tmp_path / "csv"), skip_malformed=False).filter("malformed").count() == events.count()


def test_wide_ids_in_writes_reads_and_shards(spark):
    from driftmap.model import WIDE_SCHEMA
    from driftmap.operators import reads, writes

    base = dict.fromkeys(COLUMNS, 0) | dict.fromkeys(("event_id", "correlation_id", "user_data"), "0" * 32)
    ids = [WIDE, WIDE[:16] + "0" * 15 + "8", "0" * 32, "f" * 32, WIDE]
    data = [tuple((base | {"entity_id": x, "ts_ns": 10 + i})[c] for c in COLUMNS) + (i,) for i, x in enumerate(ids)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in WIDE_SCHEMA)
    batch = spark.createDataFrame(data, schema + ", seq bigint")
    state = spark.createDataFrame([], schema + ", cell_key bigint")
    codes, after = writes.insert_events(state, batch, 100)
    assert [r["code"] for r in codes.orderBy("seq").collect()] == [0, 0, 7, 16, 0]
    held = {r["entity_id"]: r for r in after.collect()}
    assert set(held) == set(ids[:2]) and held[WIDE]["event_id"] == "1000000000000001" + "000000000000000e"
    assert reads.query_uuid(after, WIDE, 50).first()["status"] == 0 and reads.query_uuid_batch(after, [WIDE, "0" * 32], 50).filter("found").count() == 1
    gone, after = writes.delete_entities(after, spark.createDataFrame([(0, WIDE), (1, "0" * 32), (2, "a" * 32)], "seq bigint, entity_id string"), 99)
    assert [r["code"] for r in gone.orderBy("seq").collect()] == [0, 2, 3] and after.filter("flags = 32").count() == 1
    shard = spark.createDataFrame([(WIDE,), ("0" * 31 + "7",), (None,)], "e string").select(regions.shard(F.col("e"), 16)).collect()
    want = regions.jump(regions.shard_keys(np.array([7, 7], np.uint64), np.array([2**64 - 1, 0], np.uint64)), 16)
    assert [r[0] for r in shard] == [*want.tolist(), None]


def test_hex_ids_are_never_cut(spark):
    df = spark.createDataFrame([("7fffffffffffffff",), ("8000000000000000",), (WIDE,), ("0x0A",), ("zz",), (None,)], "t string")
    assert [r[0] for r in df.select(text.from_hex(F.col("t"))).collect()] == [2**63 - 1, None, None, 10, None, None]


def test_csv_long_rows_and_dry_run(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("entity_id,latitude,longitude,timestamp_ns,note\n0a,1,2,1700000000,x\n0b,1,2,1700000000," + "y" * 5000 + "\n0c,1,2,1700000001,z\n")
    assert sorted(r["entity_id"] for r in files.read_csv(spark, str(path)).collect()) == [10, 12]
    assert files.check_csv(spark, str(path)).first().asDict() == {"n_rows": 3, "readable": 2, "malformed": 1}
    seen = []
    assert files.import_csv(spark, str(path), lambda df, i: seen.extend(r["entity_id"] for r in df.collect()), batch_rows=1) == 2
    assert sorted(seen) == [10, 12]


def test_documents_over_many_lines(spark, events, tmp_path):
    for kind in ("json", "geojson"):
        docs = [json.loads(r["document"]) for r in files.documents(events, kind, 300).collect()]
        (tmp_path / kind).mkdir()
        for i, d in enumerate(docs):
            (tmp_path / kind / f"{i}.json").write_text(json.dumps(d, indent=2))
        assert rows(files.read_documents(spark, str(tmp_path / kind), kind)) == rows(events)


def test_validation_results_as_json(spark, events):
    from driftmap.operators import validation

    bad = validation.validate(events.withColumn("heading_cdeg", F.lit(40_000)).filter("entity_id <> 0 AND event_id <> 0").limit(1)).select(validation.result_json()).first()[0]
    doc = json.loads(bad)
    assert list(doc) == ["is_valid", "error_count", "errors"] and doc["is_valid"] is False and doc["error_count"] == len(doc["errors"])
    assert {"category": "heading_range", "severity": "error", "field": "heading_cdeg", "message": "heading range: heading_cdeg"} in doc["errors"]


def test_expiry_past_the_last_nanosecond_never_comes(spark):
    from driftmap.functions import ttl

    df = spark.createDataFrame([(10**18, 2**40), (2**63 - 1, 5), (0, 1)], "ts_ns bigint, ttl_seconds bigint")
    for mode in ("read", "cleanup", "cold"):
        assert [r[0] for r in df.select(ttl.is_expired(10**18, mode)).collect()] == [False, False, True]
    assert [r[0] for r in df.select(ttl.remaining_seconds(10**18)).collect()] == [None, None, 0]


def test_routes_and_migration_batches(spark, events):
    many = {i: 1 + i % 3 for i in range(5000)}
    got = regions.route(spark.range(6000).withColumnRenamed("id", "entity_id"), "explicit", [], many, default=9).groupBy("region_id").count().collect()
    assert {r["region_id"]: r["count"] for r in got} == {1: 1667, 2: 1667, 3: 1666, 9: 1000}
    ids = spark.range(20_000).withColumnRenamed("id", "entity_id")
    moving = regions.migration_batches(ids, 8, 16, 100).groupBy("source", "target", "batch").agg(F.sum("n_rows").alias("n")).collect()
    plan = {(r["source"], r["target"]): r["entities"] for r in regions.moved(ids, 8, 16).collect()}
    assert sum(r["n"] for r in moving) == sum(plan.values()) and max(r["n"] for r in moving) < 160


def test_reserved_bytes_and_machine_local_folders(spark, monkeypatch):
    from driftmap import state
    from driftmap.operators import writes

    df = spark.createDataFrame([(1, 0, 0, 0, b"\0\0"), (2, 0, 0, 0, b"\0\1"), (3, 0, 0, 0, None)], "entity_id bigint, lat_nano bigint, lon_nano bigint, heading_cdeg bigint, reserved binary")
    assert [r[0] for r in df.select(writes.event_code(df.schema)).collect()] == [0, 4, 0]

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        state.shared_dir(Session)
