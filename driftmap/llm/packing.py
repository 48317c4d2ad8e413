"""Variable-capacity best-fit packing of documents into training sequences.

Sequences may have any of several permitted lengths. Pieces are placed longest first; each
goes to the open bin whose room it fills best, the earliest of equals. Where none has room
a new bin is opened at the size of least cost: what the size costs (linear and attention
terms), less the worth of the room that pieces still to come can fill. At the end each bin
is reduced to the least permitted length that holds its contents.

Pieces are dealt by hash into shards of about ``SHARD_ITEMS``; shards are packed independently,
so no task sees more than its shard and no bin crosses one. The hash takes in a piece's number
and, of equal rows, which of them it belongs to, so neither a long document nor a repeated one
fills a shard.

A document's length is its words and one end token. One longer than the largest bin is cut
into full pieces and a rest: nothing is dropped. Ids are integers (others are read as null).
Defined results: null and empty texts have length 1; repeated rows are placed once for each
row; of equal lengths the smaller id comes first; an empty table gives no bins.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

CAPACITIES = (512, 1024, 2048, 4096)
SHARD_ITEMS = 2048
ATTENTION = 8192.0  # tokens at which the attention term equals the linear one


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / ATTENTION)


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each length, and each bin's final capacity.

    ``lengths`` are between 1 and the largest capacity; ties keep their order.
    """
    sizes = sorted(capacities)
    rate = min(cost(c) / c for c in sizes)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    left = sum(lengths)
    room: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]  # bins by what they still hold
    open_ = 0  # bit r: some bin has room r
    used: list[int] = []
    limit: list[int] = []
    places = [(0, 0)] * len(lengths)
    for i in order:
        n = lengths[i]
        left -= n
        fits = open_ >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = heapq.heappop(room[r])
            if not room[r]:
                open_ ^= 1 << r
        else:
            b = len(used)
            used.append(0)
            limit.append(min((c for c in sizes if c >= n), key=lambda c: (cost(c) - rate * min(c - n, left), c)))
        places[i] = (b, used[b])
        used[b] += n
        r = limit[b] - used[b]
        if r:
            heapq.heappush(room[r], b)
            open_ |= 1 << r
    return places, [next(c for c in sizes if c >= u) for u in used]


SCHEMA = "shard bigint, bin bigint, capacity bigint, offset bigint, id bigint, piece bigint, start bigint, length bigint"


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spread, total, copies): each document's length, and how many rows are equal to it."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("spread"), (words + 1).alias("total"))
    return sized.groupBy("id", "spread", "total").agg(F.count(F.lit(1)).alias("copies"))


def pieces(sized: DataFrame, largest: int = CAPACITIES[-1]) -> DataFrame:
    """(id, spread, copy, piece, start, length): each row of each document, cut where it is longer than ``largest``."""
    count = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    cut = sized.withColumn("copy", count(F.col("copies"))).withColumn("piece", count(_pieces(largest)))
    start = F.col("piece") * largest
    return cut.select("id", "spread", "copy", "piece", start.alias("start"), F.least(F.lit(largest), F.col("total") - start).alias("length"))


def _pieces(largest: int) -> Column:
    return F.ceil(F.col("total") / largest)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: Sequence[int] = CAPACITIES, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Where every piece of every document lies, in the columns of ``SCHEMA``."""
    largest, sizes = max(capacities), tuple(capacities)
    sized = materialise(sizes_of(docs, id_col, text_col), "sizes")
    count = sized.agg(F.sum(F.col("copies") * _pieces(largest))).first()[0] or 0
    shards = max(1, -(-count // shard_items))
    rows = pieces(sized, largest).withColumn("shard", F.pmod(F.xxhash64("spread", "copy", "piece"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("spread", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_pylist()
        places, final = pack(lengths, sizes)
        shard = table.column("shard")
        at = pa.array([b for b, _ in places], pa.int64())
        return pa.table({
            "shard": shard, "bin": at, "capacity": pa.array([final[b] for b, _ in places], pa.int64()), "offset": pa.array([o for _, o in places], pa.int64()),
            "id": table.column("id"), "piece": table.column("piece"), "start": table.column("start"), "length": table.column("length"),
        })

    packed = rows.groupBy("shard").applyInArrow(run, SCHEMA)
    return packed.select(
        F.col("id").alias(id_col), "piece", "start", "length", (F.col("shard") * F.lit(1 << 32) + F.col("bin")).alias("bin"), "offset", "capacity"
    )
