"""Geometry as native columns, and polygon checks as exact integers on the driver."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import EARTH_RADIUS_MM, NANO, QueryStatus, div

Vertex = tuple[int, int]  # latitude, longitude in nanodegrees
UNROLLED_EDGES, MOST_BINS, MOST_COPIES = 16, 4096, 40_000
#: Limits on polygons.
MAX_VERTICES, MAX_HOLES = 10_000, 100
DEGENERATE_CROSS, MAX_SPAN = 1_000_000, 350 * NANO
#: Fixed value: millimetres a degree that the bounding box of reference semantics assumes.
BOX_MM_PER_DEGREE = 111_320_000


def radians(nano: Column) -> Column:
    return nano / F.lit(1e9) * F.lit(math.pi / 180)


def haversine_mm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in millimetres, as a double."""
    p1, p2 = radians(lat1), radians(lat2)
    s_lat, s_lon = F.sin((p2 - p1) / 2), F.sin((radians(lon2) - radians(lon1)) / 2)
    a = s_lat * s_lat + F.cos(p1) * F.cos(p2) * s_lon * s_lon
    return F.lit(2.0 * EARTH_RADIUS_MM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The same formula as SQL text."""
    r = lambda x: f"(({x}) / 1e9 * {math.pi / 180!r})"
    s = lambda x, y: f"sin(({r(y)} - {r(x)}) / 2)"
    a = f"({s(lat1, lat2)} * {s(lat1, lat2)} + cos({r(lat1)}) * cos({r(lat2)}) * {s(lon1, lon2)} * {s(lon1, lon2)})"
    return f"({2.0 * EARTH_RADIUS_MM!r} * atan2(sqrt({a}), sqrt(greatest(0.0, 1 - {a}))))"


def within_distance(lat: Column, lon: Column, lat0: int, lon0: int, radius_mm: int) -> Column:
    """Whether a point lies in a circle; distances count in whole millimetres."""
    return F.floor(haversine_mm(F.lit(lat0), F.lit(lon0), lat, lon)) <= radius_mm


def radius_box(lat: Column, lon: Column, lat0: int, lon0: int, radius_mm: int) -> Column:
    """A predicate that the circle implies and that Parquet statistics can prune by.

    Bounds are those of the circle itself, a little widened; near a pole or across the
    antimeridian only the latitude is bounded.
    """
    angle = radius_mm / EARTH_RADIUS_MM
    d_lat = math.ceil(math.degrees(angle) * NANO * (1 + 1e-9)) + 10
    box = lat.between(lat0 - d_lat, lat0 + d_lat)
    top = abs(math.radians(lat0 / NANO)) + angle
    if top < math.pi / 2 and angle < math.pi / 2:
        ratio = math.sin(angle) / math.cos(math.radians(lat0 / NANO))
        if ratio < 1:
            d_lon = math.ceil(math.degrees(math.asin(ratio)) * NANO * (1 + 1e-9)) + 10
            if lon0 - d_lon >= -180 * NANO and lon0 + d_lon <= 180 * NANO:
                box = box & lon.between(lon0 - d_lon, lon0 + d_lon)
    return box


def reference_box(lat: Column, lon: Column, lat0: int, lon0: int, radius_mm: int) -> Column:
    """The narrower box of reference semantics, which clips the circle's north and south."""
    d_lat = int(radius_mm * NANO / BOX_MM_PER_DEGREE)
    box = lat.between(lat0 - d_lat, lat0 + d_lat)
    scale = math.cos(math.radians(lat0 / NANO))
    if scale <= 1e-9:
        return box
    d_lon = int(d_lat / scale)
    if lon0 - d_lon < -180 * NANO or lon0 + d_lon > 180 * NANO:
        return box
    return box & lon.between(lon0 - d_lon, lon0 + d_lon)


# --- polygons --------------------------------------------------------------------------


class PolygonError(ValueError):
    """A polygon that cannot be queried; ``status`` says why."""

    def __init__(self, status: QueryStatus, why: str) -> None:
        super().__init__(why)
        self.status = status


@dataclass(frozen=True)
class Polygon:
    """A checked outer ring, counter-clockwise, and its holes."""

    outer: tuple[Vertex, ...]
    holes: tuple[tuple[Vertex, ...], ...] = ()

    @staticmethod
    def of(outer: Sequence[Vertex], holes: Sequence[Sequence[Vertex]] = ()) -> Polygon:
        """Check and orient; closing vertices are dropped first."""
        ring = open_ring(outer)
        if len(ring) < 3:
            raise PolygonError(QueryStatus.INVALID, "a polygon has three vertices or more")
        if len(ring) > MAX_VERTICES:
            raise PolygonError(QueryStatus.POLYGON_TOO_COMPLEX, f"more than {MAX_VERTICES} vertices")
        if len(holes) > MAX_HOLES:
            raise PolygonError(QueryStatus.TOO_MANY_HOLES, f"more than {MAX_HOLES} holes")
        inner = [open_ring(h) for h in holes]
        if any(len(h) < 3 for h in inner):
            raise PolygonError(QueryStatus.HOLE_VERTEX_COUNT, "a hole has three vertices or more")
        if signed_area(ring) < 0:
            ring = ring[::-1]
        if is_degenerate(ring):
            raise PolygonError(QueryStatus.POLYGON_DEGENERATE, "all vertices lie on a line")
        if is_self_intersecting(ring):
            raise PolygonError(QueryStatus.POLYGON_SELF_INTERSECTING, "two edges cross")
        if span(ring) > MAX_SPAN:
            raise PolygonError(QueryStatus.POLYGON_TOO_LARGE, "spans more than 350 degrees of longitude")
        boxes = [bounds(h) for h in inner]
        a, b, c, d = bounds(ring)
        for h, (la, lb, oa, ob) in zip(inner, boxes, strict=True):
            if la < a or lb > b or oa < c or ob > d or not all(contains(ring, v) for v in h):
                raise PolygonError(QueryStatus.HOLE_NOT_CONTAINED, "a hole leaves the outer ring")
        order = sorted(boxes)
        for i, x in enumerate(order):
            for y in order[i + 1 :]:
                if y[0] > x[1]:
                    break
                if x[2] <= y[3] and y[2] <= x[3]:
                    raise PolygonError(QueryStatus.HOLES_OVERLAP, "the boxes of two holes overlap")
        return Polygon(tuple(ring), tuple(map(tuple, inner)))


def open_ring(ring: Sequence[Vertex]) -> list[Vertex]:
    ring = [tuple(v) for v in ring]
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def edges(ring: Sequence[Vertex]) -> list[tuple[Vertex, Vertex]]:
    return list(zip(ring, [*ring[1:], ring[0]], strict=True))


def signed_area(ring: Sequence[Vertex]) -> int:
    """Twice the signed area; positive if counter-clockwise with longitude to the right."""
    return sum(p[1] * q[0] - q[1] * p[0] for p, q in edges(ring))


def bounds(ring: Sequence[Vertex]) -> tuple[int, int, int, int]:
    lats, lons = [v[0] for v in ring], [v[1] for v in ring]
    return min(lats), max(lats), min(lons), max(lons)


def span(ring: Sequence[Vertex]) -> int:
    _, _, low, high = bounds(ring)
    return high - low


def _cross(o: Vertex, p: Vertex, q: Vertex) -> int:
    return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])


def is_degenerate(ring: Sequence[Vertex]) -> bool:
    return all(abs(_cross(ring[0], p, q)) <= DEGENERATE_CROSS for p, q in zip(ring[1:], ring[2:], strict=False))


def _side(p: Vertex, q: Vertex, r: Vertex) -> int:
    turn = _cross(p, q, r)
    return (turn > 0) - (turn < 0)


def crossings(ring: Sequence[Vertex]) -> list[tuple[int, int]]:
    """Pairs of edges that do not follow one another and yet meet.

    Two edges count as meeting if either's ends differ in side of the other, an end on the
    line being a side of its own.
    """
    return list(_crossings(ring))


def _crossings(ring: Sequence[Vertex]) -> Iterator[tuple[int, int]]:
    """Each edge against all later ones at once, in floating point; exact where that is close."""
    own, n = edges(ring), len(ring)
    p = np.array(ring, float)
    q = np.roll(p, -1, axis=0)

    def sides(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signs of the turns a-b-c, and where rounding could have changed them."""
        left, right = (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]), (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])
        return np.sign(left - right), np.abs(left - right) <= 1e-12 * (np.abs(left) + np.abs(right))

    for i in range(n - 2):
        j = np.arange(i + 2, n - (i == 0))
        turns = [sides(p[i], q[i], p[j]), sides(p[i], q[i], q[j]), sides(p[j], q[j], p[i]), sides(p[j], q[j], q[i])]
        may = (turns[0][0] != turns[1][0]) & (turns[2][0] != turns[3][0])
        close = turns[0][1] | turns[1][1] | turns[2][1] | turns[3][1]
        for k in j[may | close].tolist():
            (a, b), (c, d) = own[i], own[k]
            if _side(a, b, c) != _side(a, b, d) and _side(c, d, a) != _side(c, d, b):
                yield i, k


def is_self_intersecting(ring: Sequence[Vertex]) -> bool:
    return len(ring) > 3 and next(_crossings(ring), None) is not None


def meeting_point(ring: Sequence[Vertex], i: int, j: int) -> tuple[float, float] | None:
    """Where the lines of two edges meet, in nanodegrees; None if they are parallel."""
    (a, b), (c, d) = edges(ring)[i], edges(ring)[j]
    turn = (b[0] - a[0]) * (d[1] - c[1]) - (b[1] - a[1]) * (d[0] - c[0])
    if not turn:
        return None
    t = ((c[0] - a[0]) * (d[1] - c[1]) - (c[1] - a[1]) * (d[0] - c[0])) / turn
    return a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])


def crosses_antimeridian(ring: Sequence[Vertex]) -> bool:
    return any(abs(p[1] - q[1]) > 180 * NANO for p, q in edges(ring))


def _shifted(ring: Sequence[Vertex]) -> list[Vertex]:
    return [(la, lo + 360 * NANO if lo < 0 else lo) for la, lo in ring]


def contains(ring: Sequence[Vertex], point: Vertex) -> bool:
    """Point in ring by the parity of edges north of the point, on the driver."""
    if crosses_antimeridian(ring):
        ring, point = _shifted(ring), _shifted([point])[0]
    inside = False
    for q, p in edges(ring):
        if (p[1] > point[1]) != (q[1] > point[1]):
            inside ^= point[0] < p[0] + (point[1] - p[1]) / (q[1] - p[1]) * (q[0] - p[0])
    return inside


def _edge_hit(lat: Column, lon: Column, p: Vertex, q: Vertex) -> Column:
    at = F.lit(float(p[0])) + (lon - F.lit(p[1])).cast("double") / F.lit(float(q[1] - p[1])) * F.lit(float(q[0] - p[0]))
    return F.when(((F.lit(p[1]) > lon) != (F.lit(q[1]) > lon)) & (lat.cast("double") < at), 1).otherwise(0)


def in_ring(ring: Sequence[Vertex], lat: Column, lon: Column) -> Column:
    """Point in ring as a native column.

    Edges along a meridian never cross the ray. Few edges are unrolled into one expression.
    Many are dealt to bins of longitude in a literal, and a point is tested against the edges
    of its own bin: a few, however many the ring has.
    """
    if crosses_antimeridian(ring):
        ring, lon = _shifted(ring), F.when(lon < 0, lon + 360 * NANO).otherwise(lon)
    own = [(q, p) for p, q in edges(ring) if p[1] != q[1]]
    if not own:
        return F.lit(False)
    if len(own) <= UNROLLED_EDGES:
        return reduce(lambda x, y: x + y, [_edge_hit(lat, lon, p, q) for p, q in own]) % 2 == 1
    _, _, west, east = bounds(ring)
    bins = min(4 * len(own), MOST_BINS)
    widths = [abs(p[1] - q[1]) for p, q in own]
    while bins > 1 and sum(w * bins // (east - west) + 1 for w in widths) > MOST_COPIES + 2 * len(own):
        bins //= 2  # wide edges lie in many bins: the literal stays bounded
    width = -(-(east - west + 1) // bins)
    cells: list[list[list[int]]] = [[] for _ in range(bins)]
    for p, q in own:
        low, high = sorted((p[1], q[1]))
        for k in range((low - west) // width, (high - 1 - west) // width + 1):
            cells[k].append([*p, *q])
    table = F.from_json(F.lit(json.dumps(cells)), "array<array<array<double>>>")  # folded into a literal
    x, y = lat.cast("double"), lon.cast("double")
    hit = lambda e: ((e[1] > y) != (e[3] > y)) & (x < e[0] + (y - e[1]) / (e[3] - e[1]) * (e[2] - e[0]))
    own_cell = F.get(table, div(lon - west, width).cast("int"))
    odd = F.aggregate(own_cell, F.lit(0), lambda n, e: n + F.when(hit(e), 1).otherwise(0)) % 2 == 1
    return F.when(lon.between(west, east), odd).otherwise(False)


def in_polygon(polygon: Polygon, lat: Column, lon: Column) -> Column:
    """Inside the outer ring and outside every hole; the ring's box comes first, for pruning."""
    low, high, west, east = bounds(polygon.outer)
    box = lat.between(low, high)
    if not crosses_antimeridian(polygon.outer):
        box = box & lon.between(west, east)
    inside = box & in_ring(polygon.outer, lat, lon)
    for hole in polygon.holes:
        inside = inside & ~in_ring(hole, lat, lon)
    return inside


def in_ring_sql(ring: Sequence[Vertex], lat: str = "lat_nano", lon: str = "lon_nano") -> str:
    """The same test as SQL text, for rings that do not cross the antimeridian."""
    own = [(q, p) for p, q in edges(ring) if p[1] != q[1]]
    terms = [
        f"CASE WHEN (({p[1]} > {lon}) <> ({q[1]} > {lon})) AND CAST({lat} AS DOUBLE) < CAST({p[0]} AS DOUBLE) + "
        f"CAST({lon} - {p[1]} AS DOUBLE) / CAST({q[1] - p[1]} AS DOUBLE) * CAST({q[0] - p[0]} AS DOUBLE) THEN 1 ELSE 0 END".replace("- -", "+ ")
        for p, q in own
    ]
    return "((" + " + ".join(terms) + ") % 2 = 1)"


# --- coordinate systems ----------------------------------------------------------------

# The ellipsoid of the Chinese datum, and the box in which it applies.
GCJ_A, GCJ_EE = 6378245.0, 0.00669342162296594323
CHINA = (3.86, 53.55, 73.66, 135.05)
BD_PI = math.pi * 3000.0 / 180.0
Pair = tuple[Column, Column]  # latitude, longitude in degrees


def _waves(x: Column, *terms: tuple[float, float]) -> Column:
    """Two thirds of a sum of sines: amplitude and frequency in half turns."""
    return reduce(lambda a, b: a + b, [F.lit(amp) * F.sin(x * F.lit(freq * math.pi)) for amp, freq in terms]) * F.lit(2.0) / F.lit(3.0)


def wgs84_to_gcj02(lat: Column, lon: Column) -> Pair:
    """The published offset polynomials (fixed values: their coefficients); points outside the box stay."""
    x, y = lon - 105.0, lat - 35.0
    root = F.sqrt(F.abs(x))
    common = _waves(x, (20.0, 6.0), (20.0, 2.0))
    north = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root + common
    north = north + _waves(y, (20.0, 1.0), (40.0, 1 / 3)) + _waves(y, (160.0, 1 / 12), (320.0, 1 / 30))
    east = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root + common
    east = east + _waves(x, (20.0, 1.0), (40.0, 1 / 3)) + _waves(x, (150.0, 1 / 12), (300.0, 1 / 30))
    phi = lat * math.pi / 180
    magic = 1 - GCJ_EE * F.sin(phi) * F.sin(phi)
    d_lat = north * 180.0 / ((GCJ_A * (1 - GCJ_EE)) / (magic * F.sqrt(magic)) * math.pi)
    d_lon = east * 180.0 / (F.lit(GCJ_A) / F.sqrt(magic) * F.cos(phi) * math.pi)
    south, top, west, right = CHINA
    inside = (lon > west) & (lon < right) & (lat > south) & (lat < top)
    return F.when(inside, lat + d_lat).otherwise(lat), F.when(inside, lon + d_lon).otherwise(lon)


def gcj02_to_wgs84(lat: Column, lon: Column) -> Pair:
    """One step of the inverse: the offset at the shifted point is taken for that at the true one."""
    a, b = wgs84_to_gcj02(lat, lon)
    return lat * 2 - a, lon * 2 - b


def gcj02_to_bd09(lat: Column, lon: Column) -> Pair:
    z = F.sqrt(lon * lon + lat * lat) + 0.00002 * F.sin(lat * BD_PI)
    theta = F.atan2(lat, lon) + 0.000003 * F.cos(lon * BD_PI)
    return z * F.sin(theta) + 0.006, z * F.cos(theta) + 0.0065


def bd09_to_gcj02(lat: Column, lon: Column) -> Pair:
    x, y = lon - 0.0065, lat - 0.006
    z = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * BD_PI)
    theta = F.atan2(y, x) - 0.000003 * F.cos(x * BD_PI)
    return z * F.sin(theta), z * F.cos(theta)


COORDINATE_TRANSFORMS = {
    "wgs84_to_gcj02": wgs84_to_gcj02,
    "gcj02_to_wgs84": gcj02_to_wgs84,
    "gcj02_to_bd09": gcj02_to_bd09,
    "bd09_to_gcj02": bd09_to_gcj02,
}
