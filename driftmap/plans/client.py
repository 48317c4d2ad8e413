"""A client by the method names that users of event stores know, in degrees, metres and seconds.

Builders check their arguments before anything runs; reads return DataFrames, writes result
codes. ``now`` gives the commit time in nanoseconds and is a parameter, so replays repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.geo import MAX_HOLES, MAX_VERTICES
from ..operators.latest import latest, scatter_merge
from ..operators.reads import BATCH_LIMIT, DEFAULT_LIMIT, MAX_LIMIT, QueryResult
from ..state import keep
from .engine import Engine, Query

Point = tuple[float, float]


def _place(latitude: float, longitude: float) -> None:
    if not (-90 <= latitude <= 90 and -180 <= longitude <= 180):
        raise ValueError("coordinates out of range")


def _limit(limit: int) -> None:
    if not 0 < limit <= MAX_LIMIT:
        raise ValueError(f"a limit is between 1 and {MAX_LIMIT}")


def radius_query(latitude: float, longitude: float, radius_m: float, limit: int = DEFAULT_LIMIT, timestamp_min: int = 0, timestamp_max: int = 0, group_id: int = 0) -> Query:
    _place(latitude, longitude)
    _limit(limit)
    if radius_m <= 0:
        raise ValueError("a radius is positive")
    return Query("radius", {"latitude": latitude, "longitude": longitude, "radius_m": radius_m, "limit": limit, "ts_min": timestamp_min, "ts_max": timestamp_max, "group_id": group_id})


def polygon_query(vertices: Sequence[Point], holes: Sequence[Sequence[Point]] = (), limit: int = DEFAULT_LIMIT, timestamp_min: int = 0, timestamp_max: int = 0, group_id: int = 0) -> Query:
    _limit(limit)
    if not 3 <= len(vertices) <= MAX_VERTICES or len(holes) > MAX_HOLES or any(len(h) < 3 for h in holes):
        raise ValueError("a ring has three vertices or more; a polygon has bounds on vertices and holes")
    for ring in (vertices, *holes):
        for p in ring:
            _place(*p)
    return Query("polygon", {"vertices": list(vertices), "holes": list(holes), "limit": limit, "ts_min": timestamp_min, "ts_max": timestamp_max, "group_id": group_id})


class GeoClient:
    """One store of events; several stores answer together in the ``scatter`` methods."""

    def __init__(self, spark: SparkSession, now: Callable[[], int], events: DataFrame | None = None, default_ttl: int = 0) -> None:
        self.engine, self.now = Engine(spark, events, default_ttl), now

    def insert_events(self, events: Sequence[dict] | DataFrame) -> DataFrame:
        return self.engine.insert(events, self.now())

    def upsert_events(self, events: Sequence[dict] | DataFrame) -> DataFrame:
        return self.engine.upsert(events, self.now())

    def delete_entities(self, entity_ids: Sequence[int]) -> DataFrame:
        return self.engine.delete(entity_ids, self.now())

    def get_latest_by_uuid(self, entity_id: int) -> DataFrame:
        return self.engine.run(Query("uuid", {"entity_id": entity_id}), self.now()).df

    def get_latest_batch(self, entity_ids: Sequence[int]) -> DataFrame:
        if len(entity_ids) > BATCH_LIMIT:
            raise ValueError(f"at most {BATCH_LIMIT} ids")
        return self.engine.run(Query("uuid_batch", {"entity_ids": entity_ids}), self.now()).df

    def query_radius(self, *args, **kwargs) -> QueryResult:
        return self.engine.run(radius_query(*args, **kwargs), self.now())

    def query_polygon(self, *args, **kwargs) -> QueryResult:
        return self.engine.run(polygon_query(*args, **kwargs), self.now())

    def query_latest(self, limit: int = DEFAULT_LIMIT, group_id: int = 0, cursor_timestamp: int = 0) -> QueryResult:
        _limit(limit)
        return self.engine.run(Query("latest", {"limit": limit, "group_id": group_id, "cursor_ts": cursor_timestamp}), self.now())

    def set_ttl(self, entity_id: int, ttl_seconds: int) -> DataFrame:
        return self.engine.ttl("set", entity_id, ttl_seconds)

    def extend_ttl(self, entity_id: int, extend_by_seconds: int) -> DataFrame:
        return self.engine.ttl("extend", entity_id, extend_by_seconds)

    def clear_ttl(self, entity_id: int) -> DataFrame:
        return self.engine.ttl("clear", entity_id)

    def cleanup_expired(self, batch_size: int = 0) -> DataFrame:
        return self.engine.cleanup_expired(self.now(), batch_size)

    def get_status(self) -> DataFrame:
        return self.engine.status(self.now())

    def ping(self) -> bool:
        """Whether the session answers."""
        return self.engine.spark.range(1).count() == 1

    def get_topology(self) -> dict:
        """What stands for nodes and shards: the master, its parallelism, shuffle partitions."""
        sc = self.engine.spark.sparkContext
        return {"master": sc.master, "parallelism": sc.defaultParallelism, "partitions": int(self.engine.spark.conf.get("spark.sql.shuffle.partitions"))}


def scatter(clients: Sequence[GeoClient], query: Query, policy: str = "all", limit: int = DEFAULT_LIMIT) -> tuple[DataFrame, bool]:
    """One answer of several stores, the newest of each entity; whether a store failed.

    ``policy``: all stores must answer, a majority, or as many as can (best_effort).
    """
    if policy not in ("all", "majority", "best_effort"):
        raise ValueError(f"no such policy: {policy}")
    parts, failed = [], []
    for c in clients:
        try:
            parts.append(keep(latest(c.engine.run(query, c.now()).df)))  # runs now, so that a store's failure shows here
        except Exception as e:
            failed.append(e)
    need = {"all": len(clients), "majority": len(clients) // 2 + 1, "best_effort": 1}[policy]
    if len(parts) < need:
        raise failed[0] if failed else ValueError("no stores")
    return scatter_merge(parts, limit), bool(failed)


def query_radius_scatter(clients: Sequence[GeoClient], *args, policy: str = "all", **kwargs) -> tuple[DataFrame, bool]:
    q = radius_query(*args, **kwargs)
    return scatter(clients, q, policy, q.args["limit"])


def query_polygon_scatter(clients: Sequence[GeoClient], *args, policy: str = "all", **kwargs) -> tuple[DataFrame, bool]:
    q = polygon_query(*args, **kwargs)
    return scatter(clients, q, policy, q.args["limit"])
