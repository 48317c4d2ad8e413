"""The engine: a log of events behind one object, with reads, writes, batches and text.

State is a DataFrame, one row per entity, kept as a checkpoint after each write. Writes return
result codes and put a new state in place; nothing is mutated, so a transaction is a state to
go back to.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import Polygon, PolygonError
from ..model import COLUMNS, EVENT_SCHEMA, NANO, QueryStatus, to_nano
from ..operators import reads, writes
from ..operators.latest import latest, status
from ..state import keep
from .console import Command, parse
from .prepared import Registry

#: Fixed value: queries in a batch.
BATCH_QUERIES = 100


@dataclass(frozen=True)
class Query:
    """One query of a batch: uuid, radius, polygon or latest, and its arguments."""

    kind: str
    args: dict = field(default_factory=dict)


def _degrees(e: dict) -> dict:
    """Client units to columns: degrees, metres and metres a second are rounded."""
    out = dict.fromkeys(COLUMNS, 0)
    scale = {"altitude_m": ("altitude_mm", 1000), "accuracy_m": ("accuracy_mm", 1000), "velocity_mps": ("velocity_mms", 1000), "heading": ("heading_cdeg", 100)}
    for k, v in e.items():
        if k == "latitude":
            out["lat_nano"] = to_nano(v)
        elif k == "longitude":
            out["lon_nano"] = to_nano(v)
        elif k == "timestamp":
            out["ts_ns"] = v
        elif k in scale:
            out[scale[k][0]] = round(v * scale[k][1])
        elif k in out:
            out[k] = v
        else:
            raise ValueError(f"no such field: {k}")
    return out


class Engine:
    """Queries over a log of events, or over the state that writes have made of it."""

    def __init__(self, spark: SparkSession, events: DataFrame | None = None, default_ttl: int = 0) -> None:
        self.spark, self.default_ttl = spark, default_ttl
        self.state = latest(events) if events is not None else spark.createDataFrame([], EVENT_SCHEMA)
        self.prepared = Registry()
        self.settings: dict[str, str] = {}
        self._before: list[DataFrame] = []

    # writes

    def events(self, rows: Sequence[dict]) -> DataFrame:
        """Rows in client units as a batch with arrival order; absent ids are numbered."""
        full = [_degrees(r) for r in rows]
        data = [tuple(int(r[c]) for c in COLUMNS) + (i,) for i, r in enumerate(full)]
        return self.spark.createDataFrame(data, EVENT_SCHEMA.simpleString()[7:-1].replace(":", " ") + ", seq bigint")

    def insert(self, batch: DataFrame | Sequence[dict], commit_ns: int) -> DataFrame:
        """Codes (seq, entity_id, code); the new state takes the old one's place."""
        rows = batch if isinstance(batch, DataFrame) else self.events(batch)
        codes, state = writes.insert_events(self.state, rows, commit_ns, self.default_ttl)
        self.state = keep(state)
        return codes

    upsert = insert

    def delete(self, ids: Sequence[int], commit_ns: int) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(ids)), "seq bigint, entity_id bigint")
        codes, state = writes.delete_entities(self.state, rows, commit_ns)
        self.state = keep(state)
        return codes

    def ttl(self, how: str, entity_id: int, seconds: int = 0) -> DataFrame:
        """set, extend or clear one expiry."""
        asked = self.spark.createDataFrame([(entity_id, seconds)], "entity_id bigint, seconds bigint")
        changed = writes.change_ttl(self.state, asked, how)
        self.state = keep(writes.with_ttl(self.state, changed))
        return changed

    def cleanup_expired(self, as_of_ns: int, batch_size: int = 0) -> DataFrame:
        counted, state = writes.cleanup_expired(self.state, as_of_ns, batch_size)
        self.state = keep(state)
        return counted

    # reads

    def status(self, as_of_ns: int) -> DataFrame:
        return status(self.state, as_of_ns)

    def run(self, q: Query, as_of_ns: int) -> reads.QueryResult:
        """One query in client units: degrees and metres."""
        a = dict(q.args)
        if q.kind == "uuid":
            return reads.QueryResult(reads.query_uuid(self.state, a["entity_id"], as_of_ns))
        if q.kind == "uuid_batch":
            return reads.QueryResult(reads.query_uuid_batch(self.state, a["entity_ids"], as_of_ns))
        if q.kind == "radius":
            lat, lon, r = to_nano(a.pop("latitude")), to_nano(a.pop("longitude")), round(a.pop("radius_m") * 1000)
            return reads.query_radius(self.state, lat, lon, r, as_of_ns, **a)
        if q.kind == "polygon":
            ring = [(to_nano(x), to_nano(y)) for x, y in a.pop("vertices")]
            holes = [[(to_nano(x), to_nano(y)) for x, y in h] for h in a.pop("holes", ())]
            return reads.query_polygon(self.state, Polygon.of(ring, holes), as_of_ns, **a)
        if q.kind == "latest":
            return reads.query_latest(self.state, as_of_ns, **a)
        raise ValueError(f"no such query: {q.kind}")

    def batch(self, queries: Sequence[Query], as_of_ns: int) -> tuple[DataFrame, list[QueryStatus]]:
        """All rows with ``query_id``, and each query's status; a bad one does not stop the rest."""
        if len(queries) > BATCH_QUERIES:
            raise ValueError(f"at most {BATCH_QUERIES} queries")
        frames, codes = [], []
        for i, q in enumerate(queries):
            try:
                df = self.run(q, as_of_ns).df
                if q.kind == "uuid":
                    df = df.filter("status = 0")
                frames.append(df.select(F.lit(i).alias("query_id"), *self.state.columns))
                codes.append(QueryStatus.OK)
            except PolygonError as e:
                codes.append(e.status)
            except (ValueError, KeyError, TypeError):
                codes.append(QueryStatus.INVALID)
        empty = self.state.limit(0).select(F.lit(0).alias("query_id"), *self.state.columns)
        return reduce(DataFrame.unionByName, frames, empty), codes

    # text

    def prepare(self, name: str, text: str) -> int:
        return self.prepared.prepare(name, text)

    def execute(self, key: int | str, as_of_ns: int, *params: float) -> reads.QueryResult:
        p = self.prepared.get(key)
        return self.run(Query(p.kind.lower(), p.bind(*params)), as_of_ns)

    def query(self, line: str, as_of_ns: int) -> DataFrame:
        """Run one line of the console's grammar."""
        return self._command(parse(line), as_of_ns)

    def _command(self, c: Command, as_of_ns: int) -> DataFrame:
        a = dict(c.args)
        if c.kind == "query_uuid":
            return reads.query_uuid(self.state, a["entity_id"], as_of_ns)
        if c.kind == "query_radius":
            lat, lon = a.pop("centre")
            return reads.query_radius(self.state, lat, lon, a.pop("radius_m") * 1000, as_of_ns, **a).df
        if c.kind == "query_polygon":
            return reads.query_polygon(self.state, Polygon.of(a.pop("vertices")), as_of_ns, **a).df
        if c.kind == "query_latest":
            ids = a.pop("entity_ids")
            if ids:
                own = self.state.filter(F.col("entity_id").isin(*ids))
                return reads.query_latest(own, as_of_ns, a["limit"]).df
            return reads.query_latest(self.state, as_of_ns, a["limit"]).df
        if c.kind == "insert":
            lat, lon = a["place"]
            row = {"entity_id": a["entity_id"], "latitude": lat / NANO, "longitude": lon / NANO} | a["values"]
            return self.insert([row], as_of_ns)
        if c.kind == "delete":
            return self.delete([a["entity_id"]], as_of_ns)
        if c.kind == "set":
            self.settings[a["name"]] = a["value"]
            return self.spark.createDataFrame([(a["name"], a["value"])], "name string, value string")
        if c.kind == "show":
            if a["target"].upper() == "STATUS":
                return self.status(as_of_ns)
            return self.spark.createDataFrame(sorted(self.settings.items()), "name string, value string")
        if c.kind == "describe":
            return self.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in self.state.schema], "column string, type string")
        if c.kind == "begin":
            self._before.append(self.state)
        elif c.kind == "rollback" and self._before:
            self.state = self._before.pop()
        elif c.kind == "commit" and self._before:
            self._before.pop()
        return self.spark.createDataFrame([(c.kind,)], "done string")
