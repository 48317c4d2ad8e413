"""Identifiers, times and geometry as text."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import LAT_MAX, LON_MAX, NANO, div, to_nano
from .geo import Vertex, crossings, meeting_point, open_ring


def hex32(value: Column) -> Column:
    """A 64-bit id as 32 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(value)), 32, "0")


def event_key_hex(cell_key: Column, ts_ns: Column) -> Column:
    """The composite 128-bit event id, cell above time, as 32 hex digits."""
    cell = F.bitwise_not(cell_key).bitwiseXOR(F.lit(2**63 - 1))  # flips the sign bit
    return F.concat(F.lpad(F.lower(F.hex(cell)), 16, "0"), F.lpad(F.lower(F.hex(ts_ns)), 16, "0"))


def wide_hex(text: Column) -> Column:
    """A hex id of up to 128 bits, dashes and 0x allowed, as 32 digits; null if it is not one."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "^0x", ""), "-", "")
    return F.when(digits.rlike("^[0-9a-f]{1,32}$"), F.lpad(digits, 32, "0"))


def from_hex(text: Column) -> Column:
    """A hex id as a BIGINT; null if it is none, or has more than the 63 bits that fit."""
    digits = wide_hex(text)
    return F.when(digits.rlike("^0{16}[0-7]"), F.conv(F.right(digits, F.lit(16)), 16, 10).cast("long"))


def parse_entity_id(text: str) -> int:
    """0x and hex, else decimal, else bare hex."""
    text = text.strip()
    if re.fullmatch(r"0[xX][0-9a-fA-F]+", text):
        return int(text, 16)
    if re.fullmatch(r"\d+", text):
        return int(text)
    if re.fullmatch(r"[0-9a-fA-F]+", text):
        return int(text, 16)
    raise ValueError(f"not an entity id: {text!r}")


def iso_time(ts_ns: Column) -> Column:
    """ISO 8601 in UTC with milliseconds."""
    return F.date_format(F.timestamp_micros(div(ts_ns, 1_000_000) * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_time(text: Column) -> Column:
    """Nanoseconds from digits or ISO 8601; the number of digits tells s, ms, us and ns apart."""
    number = F.when(text.rlike(r"^\d{1,19}$"), text.cast("long"))
    size = F.length(text)
    scale = F.when(size <= 11, NANO).when(size <= 14, 1_000_000).when(size <= 17, 1_000).otherwise(1)
    iso = F.unix_micros(F.try_to_timestamp(text)) * 1000
    return F.when(number.isNotNull(), number * scale).otherwise(iso)


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


# --- geometry --------------------------------------------------------------------------

_POINT = re.compile(r"\s*POINT\s*\(\s*(\S+)\s+(\S+)\s*\)\s*", re.I)
_RINGS = re.compile(r"\(([^()]+)\)")


def _vertex(lon: float, lat: float) -> Vertex:
    la, lo = to_nano(float(lat)), to_nano(float(lon))
    if abs(la) > LAT_MAX or abs(lo) > LON_MAX:
        raise ValueError(f"coordinates out of range: {lat}, {lon}")
    return la, lo


def point_from_wkt(text: str) -> Vertex:
    m = _POINT.fullmatch(text)
    if not m:
        raise ValueError("not a WKT point")
    return _vertex(float(m.group(1)), float(m.group(2)))


def polygon_from_wkt(text: str) -> tuple[list[Vertex], list[list[Vertex]]]:
    """Outer ring and holes; a repeated last vertex is dropped."""
    if not text.strip().upper().startswith("POLYGON"):
        raise ValueError("not a WKT polygon")
    rings = [[_vertex(*map(float, p.split()[:2])) for p in r.split(",")] for r in _RINGS.findall(text)]
    return _rings(rings)


def point_from_geojson(doc: str | dict) -> Vertex:
    doc = json.loads(doc) if isinstance(doc, str) else doc
    if doc.get("type") != "Point" or len(doc.get("coordinates", ())) < 2:
        raise ValueError("not a GeoJSON point")
    return _vertex(*doc["coordinates"][:2])


def polygon_from_geojson(doc: str | dict) -> tuple[list[Vertex], list[list[Vertex]]]:
    doc = json.loads(doc) if isinstance(doc, str) else doc
    if doc.get("type") != "Polygon":
        raise ValueError("not a GeoJSON polygon")
    return _rings([[_vertex(*p[:2]) for p in r] for r in doc["coordinates"]])


def _rings(rings: list[list[Vertex]]) -> tuple[list[Vertex], list[list[Vertex]]]:
    rings = [open_ring(r) for r in rings]
    if not rings or any(len(r) < 3 for r in rings):
        raise ValueError("a ring has three points or more")
    return rings[0], rings[1:]


def _degrees(nano: int) -> str:
    text = f"{nano / NANO:.9f}".rstrip("0").rstrip(".")
    return text or "0"


def point_to_wkt(v: Vertex) -> str:
    return f"POINT({_degrees(v[1])} {_degrees(v[0])})"


def polygon_to_wkt(outer: list[Vertex], holes: list[list[Vertex]] = ()) -> str:
    rings = ["(" + ", ".join(f"{_degrees(lo)} {_degrees(la)}" for la, lo in [*r, r[0]]) + ")" for r in [outer, *holes]]
    return f"POLYGON({', '.join(rings)})"


def polygon_to_geojson(outer: list[Vertex], holes: list[list[Vertex]] = ()) -> str:
    return json.dumps({"type": "Polygon", "coordinates": [[[lo / NANO, la / NANO] for la, lo in [*r, r[0]]] for r in [outer, *holes]]})


def wkt_point_columns(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude, in nanodegrees, of a column of WKT points; null if it is none."""
    pattern = r"(?i)^\s*POINT\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)\s*\)\s*$"
    part = lambda i: F.round(F.regexp_extract(text, pattern, i).try_cast("double") * 1e9).cast("long")
    lat, lon = part(2), part(1)
    good = (F.abs(lat) <= LAT_MAX) & (F.abs(lon) <= LON_MAX)
    return F.when(good, lat), F.when(good, lon)


def explain_polygon(ring: list[Vertex]) -> list[dict]:
    """Crossing pairs of edges, where they meet, and a repair to try."""
    ring = open_ring(ring)
    out = []
    for i, j in crossings(ring) if len(ring) > 3 else []:
        at = meeting_point(ring, i, j)
        out.append({"edges": (i, j), "at": at, "repair": f"reverse the vertices {i + 1} to {j}"})
    return out
