"""URL filters as a temporal list join, in DataFrame operations only.

A list is a log of dated changes (list_name, entry, action, day): an entry is a domain
that covers itself and everything below it, added on one day and perhaps removed on a
later one. The changes become validity intervals [valid_from, valid_to); every capture is
then judged by the entries that were in force on the day it was fetched.

A verdict depends on host and day alone, so captures are first reduced to distinct
(host, day). Each of those is offered under every domain suffix of its host, and joined to
the intervals on suffix and salt: a suffix that covers a third of the web is spread over
``SALTS`` keys, for which the list, not the captures, is repeated.

Defined results: a null, relative or unparsable URL has an empty host and is never listed;
a null day is never covered; repeated captures keep their rows; of changes on one day the
removal counts last; an entry never removed is valid without end; an address, of four numbers
or in brackets, has no parents; of entries equally long the last in order is named; columns of
the captures with the names of ``ADDED`` give way to the new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[0-9A-Fa-f:.]*\]|[^/?#:@]*)"
ADDED = ("host", "listed", "n_entries", "entry", "lists")


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without trailing dots; empty where there is none."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels or more; an address has only itself."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host == "", F.array().cast("array<string>")).when(host.rlike(r"^([0-9.]+|\[.*)$"), F.array(host)).otherwise(parents)


def intervals(changes: DataFrame) -> DataFrame:
    """(list_name, entry, valid_from, valid_to) of a log of changes; valid_to null: still listed."""
    last = changes.groupBy("list_name", "entry", "day").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("removed"))
    w = Window.partitionBy("list_name", "entry").orderBy("day")
    # runs of additions make one interval: keep the changes that alter the state
    turned = last.filter("day IS NOT NULL").withColumn("before", F.lag("removed", 1, 1).over(w)).filter("removed <> before")
    closed = turned.withColumn("valid_to", F.lead("day").over(w))
    return closed.filter("removed = 0").select("list_name", F.lower("entry").alias("entry"), F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, changes: DataFrame, url_col: str = "url", day_col: str = "day", salts: int = SALTS) -> DataFrame:
    """All columns of ``captures`` and: host, listed, n_entries, entry, lists.

    ``entry`` is the most specific entry in force, ``lists`` the sorted names of all lists
    that held one.
    """
    kept = [c for c in captures.columns if c.lower() not in ADDED]
    row = F.struct(*kept) if kept else F.lit(None).cast("int")  # apart from the columns that are made here
    named = captures.select(row.alias("capture"), host_of(F.col(url_col)).alias("host"), F.col(day_col).alias("asked_day"))
    asked = named.select("host", "asked_day").filter("host <> '' AND asked_day IS NOT NULL").distinct()
    offered = asked.select("host", "asked_day", F.explode(suffixes(F.col("host"))).alias("entry"))
    offered = offered.withColumn("salt", F.pmod(F.xxhash64("host", "asked_day"), F.lit(salts)).cast("int"))
    held = intervals(changes).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    in_force = (F.col("asked_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("asked_day") < F.col("valid_to")))
    found = offered.join(held, ["entry", "salt"]).filter(in_force)
    verdicts = found.groupBy("host", "asked_day").agg(
        F.countDistinct("entry").alias("n_entries"),
        F.max_by("entry", F.struct(F.length("entry"), F.col("entry"))).alias("entry"),
        F.array_sort(F.collect_set("list_name")).alias("lists"),
    )
    joined = named.join(verdicts, ["host", "asked_day"], "left")
    return joined.select(
        *[F.col("capture")[c].alias(c) for c in kept],
        "host",
        F.col("entry").isNotNull().alias("listed"),
        F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
        "entry",
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"),
    )
