"""Every registered query against DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from driftmap import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in queries.SQL:
        assert got
        return
    rel = duck.sql(queries.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_no_python_in_core_plans(spark):
    for name in ("query_radius_10km", "query_polygon_holes", "query_latest", "write_codes", "data_profile", "incremental_latest_wins", "minimize_marketing", "export_json"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan, name


def test_a_laid_out_state_is_read_in_parts(spark, tmp_path):
    from driftmap.operators import reads, writes

    state = queries._cell_state(spark, SF)
    writes.layout(state, str(tmp_path / "s"), 4)
    found = reads.query_radius(spark.read.parquet(str(tmp_path / "s")), *queries.CENTRE, 30_000_000, queries.AS_OF, limit=None).df
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(cell_key" in pushed and "GreaterThanOrEqual(lat_nano" in pushed and "Exchange" not in plan and "Window" not in plan
    assert reads.query_radius(state, *queries.CENTRE, 30_000_000, queries.AS_OF).has_more is False


def test_filters_reach_the_scan(spark, tmp_path):
    from driftmap.model import geo_events
    from driftmap.operators.reads import radius_filter

    path = str(tmp_path / "g")
    geo_events(spark, SF).write.parquet(path)
    plan = spark.read.parquet(path).filter(radius_filter(40_000_000_000, -74_000_000_000, 5_000_000)).select("entity_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lat_nano), IsNotNull(lon_nano), GreaterThanOrEqual(lat_nano" in plan
    assert "ReadSchema: struct<entity_id:bigint,lat_nano:bigint,lon_nano:bigint>" in plan


def test_latest_is_limited_before_the_exchange(spark):
    plan = queries.QUERIES["latest_build"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1
