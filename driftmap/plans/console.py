"""The console's grammar: a line of text to a command."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import parse_entity_id
from ..model import to_nano

#: Vertices and ids a line can hold, and the limit of LATEST.
MOST_VERTICES, MOST_IDS, LATEST_LIMIT = 64, 64, 100


class ConsoleError(ValueError):
    pass


@dataclass(frozen=True)
class Command:
    """What to do, and with what."""

    kind: str
    args: dict = field(default_factory=dict)


_PLACE = re.compile(r"\(\s*([-+\d.eE]+)\s*,\s*([-+\d.eE]+)\s*\)")


def _options(words: list[str]) -> dict:
    out, at = {}, 0
    names = {"FROM": "ts_min", "START": "ts_min", "TO": "ts_max", "END": "ts_max", "LIMIT": "limit"}
    while at < len(words):
        key = names.get(words[at].upper())
        if key:
            if at + 1 >= len(words):
                raise ConsoleError(f"{words[at]} needs a value")
            if not words[at + 1].isdigit():
                raise ConsoleError(f"not a number: {words[at + 1]}")
            out[key] = int(words[at + 1])
            at += 1
        at += 1
    return out


def _places(text: str) -> tuple[list[tuple[int, int]], str]:
    out, end = [], 0
    for m in _PLACE.finditer(text):
        out.append((to_nano(float(m.group(1))), to_nano(float(m.group(2)))))
        end = m.end()
    return out, text[end:]


def _query(text: str) -> Command:
    kind, _, rest = text.strip().partition(" ")
    kind, rest = kind.upper(), rest.strip()
    if kind == "UUID":
        if not rest:
            raise ConsoleError("QUERY UUID needs an id")
        return Command("query_uuid", {"entity_id": _entity(rest.split()[0])})
    if kind == "RADIUS":
        places, rest = _places(rest)
        words = rest.split()
        if len(places) != 1 or not words:
            raise ConsoleError("QUERY RADIUS needs a place and metres")
        if not words[0].isdigit():
            raise ConsoleError(f"not a radius: {words[0]}")
        return Command("query_radius", {"centre": places[0], "radius_m": int(words[0])} | _options(words[1:]))
    if kind == "POLYGON":
        places, rest = _places(rest)
        if len(places) < 3:
            raise ConsoleError("QUERY POLYGON needs three places or more")
        if len(places) > MOST_VERTICES:
            raise ConsoleError(f"at most {MOST_VERTICES} places")
        return Command("query_polygon", {"vertices": places} | _options(rest.split()))
    if kind == "LATEST":
        words = rest.split()
        cut = next((i for i, w in enumerate(words) if w.upper() == "LIMIT"), len(words))
        ids = []
        for w in words[:cut]:
            try:
                ids.append(parse_entity_id(w))
            except ValueError:
                continue
        if len(ids) > MOST_IDS:
            raise ConsoleError(f"at most {MOST_IDS} ids")
        return Command("query_latest", {"entity_ids": ids, "limit": LATEST_LIMIT} | _options(words[cut:]))
    raise ConsoleError(f"no such query: {kind}")


def _entity(text: str) -> int:
    try:
        return parse_entity_id(text)
    except ValueError as e:
        raise ConsoleError(str(e)) from None


_INSERT = ("entity_id", "latitude", "longitude", "timestamp", "group_id", "ttl_seconds", "altitude_m", "velocity_mps", "heading", "accuracy_m")


def _insert(text: str) -> Command:
    """INSERT <id> (lat, lon) [NAME value]..."""
    places, rest = _places(text)
    head = text.split("(")[0].split()
    if not head or len(places) != 1:
        raise ConsoleError("INSERT needs an id and a place")
    words, values = rest.split(), {}
    for k, v in zip(words[::2], words[1::2], strict=False):
        if k.lower() not in _INSERT:
            raise ConsoleError(f"no such field: {k}")
        values[k.lower()] = float(v) if "." in v else int(v)
    return Command("insert", {"entity_id": _entity(head[0]), "place": places[0], "values": values})


def parse(line: str) -> Command:
    """One command; keywords in any case, a closing semicolon allowed."""
    text = line.strip().rstrip(";").strip()
    word, _, rest = text.partition(" ")
    word, rest = word.upper(), rest.strip()
    if word == "QUERY":
        return _query(rest)
    if word == "INSERT":
        return _insert(rest)
    if word == "DELETE":
        if not rest:
            raise ConsoleError("DELETE needs an id")
        return Command("delete", {"entity_id": _entity(rest.split()[0])})
    if word == "SET":
        m = re.fullmatch(r"(\S+?)\s*(?:=\s*|\s+)(\S+)", rest)
        if not m:
            raise ConsoleError("SET needs a name and a value")
        return Command("set", {"name": m.group(1), "value": m.group(2)})
    if word in ("SHOW", "DESCRIBE"):
        return Command(word.lower(), {"target": (rest.split() or ["ALL" if word == "SHOW" else "EVENTS"])[0]})
    if word in ("BEGIN", "COMMIT", "ROLLBACK", "HELP", "EXIT", "QUIT"):
        return Command(word.lower())
    raise ConsoleError(f"no such command: {word or 'nothing'}")
