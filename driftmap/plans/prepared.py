"""Prepared queries: text with numbered parameters, compiled once and bound later."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Fixed value: prepared queries a session can hold.
MOST = 32
_KINDS = {
    "UUID": re.compile(r"UUID\s+(\S+)$", re.I),
    "RADIUS": re.compile(r"RADIUS\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+LIMIT\s+(\S+))?(?:\s+GROUP\s+(\S+))?$", re.I),
    "LATEST": re.compile(r"LATEST(?:\s+LIMIT\s+(\S+))?(?:\s+GROUP\s+(\S+))?$", re.I),
}
_NAMES = {"UUID": ("entity_id",), "RADIUS": ("latitude", "longitude", "radius_m", "limit", "group_id"), "LATEST": ("limit", "group_id")}


class PreparedError(ValueError):
    pass


@dataclass(frozen=True)
class Prepared:
    """A kind of query, and for each of its arguments a value or the number of a parameter."""

    name: str
    kind: str
    arguments: dict[str, float | int | str]

    @property
    def parameters(self) -> int:
        return max((int(v[1:]) for v in self.arguments.values() if isinstance(v, str)), default=0)

    def bind(self, *params: float) -> dict[str, float | int]:
        if len(params) != self.parameters:
            raise PreparedError(f"{self.name} takes {self.parameters} parameters")
        return {k: params[int(v[1:]) - 1] if isinstance(v, str) else v for k, v in self.arguments.items()}


def compile_query(name: str, text: str) -> Prepared:
    text = text.strip()
    word = (text.split() or [""])[0].upper()
    if word not in _KINDS:
        raise PreparedError(f"cannot prepare {word or 'nothing'}")
    m = _KINDS[word].match(text)
    if not m:
        raise PreparedError(f"cannot read {text!r}")
    arguments: dict[str, float | int | str] = {}
    for key, raw in zip(_NAMES[word], m.groups(), strict=True):
        if raw is None:
            continue
        if re.fullmatch(r"\$[1-9]\d*", raw):
            arguments[key] = raw
        elif key in ("latitude", "longitude", "radius_m"):
            arguments[key] = float(raw)
        else:
            arguments[key] = int(raw, 0)
    return Prepared(name, word, arguments)


@dataclass
class Registry:
    """The prepared queries of a session, by slot and by name."""

    slots: dict[int, Prepared] = field(default_factory=dict)

    def prepare(self, name: str, text: str) -> int:
        if any(p.name == name for p in self.slots.values()):
            raise PreparedError(f"{name} is taken")
        if len(self.slots) >= MOST:
            raise PreparedError(f"a session holds {MOST} queries")
        slot = next(i for i in range(MOST) if i not in self.slots)
        self.slots[slot] = compile_query(name, text)
        return slot

    def get(self, key: int | str) -> Prepared:
        for slot, p in self.slots.items():
            if key in (slot, p.name):
                return p
        raise PreparedError(f"no such query: {key}")

    def deallocate(self, key: int | str | None = None) -> int:
        """One query, or all; how many went."""
        if key is None:
            n = len(self.slots)
            self.slots.clear()
            return n
        gone = [s for s, p in self.slots.items() if key in (s, p.name)]
        for s in gone:
            del self.slots[s]
        return len(gone)
