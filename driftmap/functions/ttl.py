"""Expiry rules. They differ by where they apply, so every caller names the one it means.

``now_ns`` is always an argument: no query reads a clock.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NANO, div

#: Expiry extended by reading.
EXTEND_BY, EXTEND_CAP, EXTEND_COOLDOWN = 86_400, 2_592_000, 3_600


def is_expired(now_ns: int, mode: str = "read", ts: str = "ts_ns", ttl: str = "ttl_seconds") -> Column:
    """Whether an event has expired; expiry 0 never comes, nor does one past the last nanosecond.

    ``read``: whole seconds, strictly after; ``cleanup``: nanoseconds, at the moment itself;
    ``cold``: nanoseconds, strictly after.
    """
    t, s = F.col(ts), F.col(ttl)
    if mode == "read":
        late = F.lit(now_ns // NANO) > F.try_add(div(t, NANO), s)
    elif mode == "cleanup":
        late = F.lit(now_ns) >= _end(t, s)
    elif mode == "cold":
        late = F.lit(now_ns) > _end(t, s)
    else:
        raise ValueError(f"no such expiry rule: {mode}")
    return (s > 0) & F.coalesce(late, F.lit(False))


def _end(t: Column, s: Column) -> Column:
    """The nanosecond of an expiry; null if there is none so late."""
    return F.try_add(t, F.try_multiply(s, F.lit(NANO)))


def expired_sql(now_ns: int, mode: str = "read") -> str:
    late = {
        "read": f"{now_ns // NANO} > ts_ns // {NANO} + ttl_seconds",
        "cleanup": f"{now_ns} >= ts_ns + ttl_seconds * {NANO}",
        "cold": f"{now_ns} > ts_ns + ttl_seconds * {NANO}",
    }[mode]
    return f"(ttl_seconds > 0 AND {late})"


def remaining_seconds(now_ns: int, ts: str = "ts_ns", ttl: str = "ttl_seconds") -> Column:
    """Whole seconds left; null if the event never expires, 0 if it has."""
    end = _end(F.col(ts), F.col(ttl))
    left = end - F.lit(now_ns)
    return F.when((F.col(ttl) > 0) & end.isNotNull(), F.when(left <= 0, F.lit(0)).otherwise(div(left, NANO)).cast("long"))


def extension(
    now_ns: int,
    ttl: Column,
    no_auto_extend: Column,
    count: Column,
    last_ns: Column,
    enabled: bool = True,
    by: int = EXTEND_BY,
    cap: int = EXTEND_CAP,
    cooldown: int = EXTEND_COOLDOWN,
    most: int = 0,
) -> Column:
    """What reading does to an expiry: a struct (result, new_ttl)."""
    longer = F.least(ttl + by, F.lit(cap))
    cases = [
        (F.lit(not enabled), "disabled", ttl),
        (ttl == 0, "no_ttl", F.lit(0)),
        (no_auto_extend, "no_auto_extend", ttl),
        (F.lit(most > 0) & (count >= most), "max_count_exceeded", ttl),
        ((last_ns > 0) & (F.greatest(F.lit(now_ns) - last_ns, F.lit(0)) < cooldown * NANO), "cooldown_active", ttl),
        (longer == ttl, "max_ttl_reached", ttl),
    ]
    out = F.struct(F.lit("extended").alias("result"), longer.cast("long").alias("new_ttl"))
    for when, name, value in reversed(cases):
        out = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(name).alias("result"), value.cast("long").alias("new_ttl"))).otherwise(out)
    return out

