"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Shingles are numbers below ``CIRCLE``, places on a circle (the low bits of fingerprints). Two
permutations of the circle give all coordinates of a signature: the first scatters a
document's places, the second is read where they have come to lie and at the same places
shifted once, twice, ... around the circle, and coordinate k is the least value found at shift k. Because shift k is the next place, one gather of ``COORDINATES``
neighbouring values per shingle yields every coordinate at once.

Links are found in three passes, so that a group of n copies never makes n * n pairs:

1. Documents with equal shingle sets are one node. Every band bucket links each node to
   the bucket's least one; these pairs are verified on the full sets.
2. Where a bucket of three or more still holds several components, the nodes outside its
   largest component are paired with a hash-chosen node of that component and with one of
   their own; verified links join components. After ``ROUNDS`` rounds few nodes stay outside.
3. These are compared with all of their buckets on the full sets, in blocks of bounded size,
   in which shared shingles are counted, so that only links leave a block: one for each node
   and other component.

Pairs within one component are not looked at again: they cannot change the components. Every
link is confirmed by counting shared 64-bit fingerprints of the full sets. A pair is missed
only if it shares no bucket: at Jaccard 0.8 with probability (1 - 0.8**4)**32 < 1e-7.

Ids are integers (others are read as null). Defined results: null, empty and blank texts have
no shingles and stand alone; rows with one id count as one node, by the one of their shingle
sets with the least key, and all get its component; a row without an id stands alone with a
null component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialise, mix64, release, shingle_hashes, word_hashes

CIRCLE = 1 << 20
COORDINATES, BANDS = 128, 32
ROWS = COORDINATES // BANDS
ROUNDS = 1
BLOCK_OUTSIDE, BLOCK_ALL = 256, 2048
SALTS = 8  # parts of a bucket in joins


class Circulant:
    """The first permutation, and the second unrolled past its end by the number of coordinates."""

    def __init__(self, coordinates: int = COORDINATES, seed: int = 5) -> None:
        self.coordinates = coordinates
        rng = np.random.default_rng(seed)
        self.first = rng.permutation(CIRCLE).astype(np.uint32)
        order = rng.permutation(CIRCLE).astype(np.uint32)
        unrolled = np.concatenate([order, order[:coordinates]])
        self.rows = np.lib.stride_tricks.sliding_window_view(unrolled, coordinates)

    def signatures(self, shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """A row of values for each non-empty run ``bounds[i]:bounds[i + 1]``."""
        at = self.first[(shingles & np.uint64(CIRCLE - 1)).astype(np.int64)]
        out = np.full((len(bounds) - 1, self.coordinates), 0xFFFFFFFF, np.uint32)
        step = 2048 * COORDINATES // self.coordinates
        for low in range(0, len(at), step):
            high = min(low + step, len(at))
            first = int(np.searchsorted(bounds, low, side="right")) - 1
            last = int(np.searchsorted(bounds, high, side="left"))
            starts = np.maximum(bounds[first:last], low) - low
            least = np.minimum.reduceat(self.rows[at[low:high]], starts, axis=0)
            np.minimum(out[first:last], least, out=out[first:last])
        return out


_CIRCULANT: dict[int, Circulant] = {}


def circulant(coordinates: int = COORDINATES) -> Circulant:
    if coordinates not in _CIRCULANT:
        _CIRCULANT[coordinates] = Circulant(coordinates)
    return _CIRCULANT[coordinates]


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text, words lower-cased."""
    words, bounds = word_hashes(texts)
    return [np.unique(shingle_hashes(words[a:b], size)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signed(texts: list[bytes], size: int) -> list[pa.Array]:
    sets = shingle_sets(texts, size)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    full = np.array([len(s) > 0 for s in sets], bool)
    edges = np.concatenate([bounds[:-1][full], bounds[-1:]])
    signed = np.full((len(sets), COORDINATES), 0xFFFFFFFF, np.uint32)
    if full.any():
        signed[full] = circulant().signatures(np.concatenate(sets), edges)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix64(bands + signed[:, r::ROWS].astype(np.uint64) + np.uint64(1))
    bands = mix64(bands + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
    keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())
    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
    return [pa.array(np.diff(bounds)), keys, listed]


def sign(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n_shingles, set_key, bands) of every whole text; no set, no key."""

    def make() -> Callable:
        return lambda texts: _signed(texts, size)

    return map_texts(docs, id_col, text_col, "id bigint, n_shingles bigint, set_key binary, bands array<bigint>", make)


def _sets_of(docs: DataFrame, size: int, nodes: DataFrame) -> DataFrame:
    """(id, shingles), one row for each node (id, set_key): packed sorted fingerprints."""

    def make() -> Callable:
        def work(texts: list[bytes]) -> list[pa.Array]:
            sets = shingle_sets(texts, size)
            return [pa.array([set_key(x) if len(x) else None for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]

        return work

    wanted = nodes.select(F.col("id").alias("wanted")).distinct()
    chosen = docs.join(wanted, docs["id"] == wanted["wanted"], "left_semi")
    sets = materialise(map_texts(chosen, "id", "text", "id bigint, set_key binary, shingles binary", make), "sets")
    if not sets.groupBy("id").count().filter("count > 1").isEmpty():  # rows that share an id
        own = materialise(sets.join(nodes.select("id", "set_key").distinct(), ["id", "set_key"], "left_semi").dropDuplicates(["id"]), "sets")
        release(sets)
        sets = own
    return sets


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share at least ``percent`` % of their union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                least, most = sorted((len(p), len(q)))
                if not least or 100 * least < percent * most:
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate([p, q]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (least + most - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")
    return both.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(id, component): the least node that each end of an edge (a, b) reaches.

    Alternates large-star and small-star steps: each node's neighbours are handed to the
    least of them, first those above the node, then those below, until nothing moves.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), label)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small, old = materialise(small, label), now
        release(old)
        # done when every node points at one other, and none of those points further: stars
        ends = small.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into"))
        ends = ends.unionByName(small.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        if ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out + into > 1").isEmpty():
            return small.select(F.col("u").alias("id"), F.col("v").alias("component"))
        now = small


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, component) after further links (a, b), by the graph of components alone."""
    new = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti")
    every = labels.unionByName(new.select("id", F.col("id").alias("component")))
    at = lambda end: every.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    between = links.join(at("a"), "a").join(at("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).filter("a <> b")
    joined = components(between, "contracted").select(F.col("id").alias("component"), F.col("component").alias("least"))
    out = materialise(every.join(joined, "component", "left").select("id", F.coalesce("least", "component").alias("component")), "labels")
    release(labels)
    return out


def _by_bucket(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (bucket, id, ...) with one row of facts a bucket; a bucket meets in ``SALTS`` tasks."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    spread = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["bucket", "salt"]).drop("salt")


def _star_pairs(buckets: DataFrame) -> DataFrame:
    least = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _by_bucket(buckets, least.select("bucket", "a")).filter("id <> a").select("a", F.col("id").alias("b")).distinct()


def _split(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, id, comp, largest, total, outside) of buckets of three or more with several components."""
    held = buckets.join(labels.withColumnRenamed("component", "comp"), "id", "left").select("bucket", "id", F.coalesce("comp", "id").alias("comp"))
    sizes = held.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("bucket").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp")).alias("top"))
    split = split.filter("comps > 1 AND total > 2").select("bucket", "total", F.col("top.comp").alias("largest"), (F.col("total") - F.col("top.n")).alias("outside"))
    return materialise(_by_bucket(held, split), "split")


def _sample_pairs(split: DataFrame, salt: int) -> DataFrame:
    """Nodes outside a bucket's largest component, each with one node of it and one of their own."""
    drawn = F.struct(F.xxhash64("id", "bucket", F.lit(salt)), F.col("id"))
    inside = F.col("comp") == F.col("largest")
    centres = split.groupBy("bucket").agg(F.min(F.when(inside, drawn)).alias("one"), F.min(F.when(~inside, drawn)).alias("other"))
    centres = centres.select("bucket", F.explode(F.array("one.id", "other.id")).alias("a"))
    pairs = _by_bucket(split.filter("comp <> largest"), centres).filter("id <> a")
    return pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()


def _shared(sets: list[np.ndarray], comp: np.ndarray, outs: np.ndarray, alls: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each of ``outs`` one of ``alls`` from each other component that it is linked with."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(alls)), size[alls])
    flat = np.concatenate([sets[i] for i in alls.tolist()])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i in outs.tolist():
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        hits = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(int(hits.sum()))
        same = np.bincount(owner[at], minlength=len(alls))
        near = np.flatnonzero((comp[alls] != comp[i]) & (100 * same >= percent * (size[alls] + size[i] - same)))
        _, first = np.unique(comp[alls][near], return_index=True)
        yield i, alls[near[first]]


def _outside_links(split: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes in one bucket but different components, enough to join the components.

    A node outside the bucket's largest component goes to one block of such nodes, which
    meets every block of all nodes, so that a task holds about ``BLOCK_OUTSIDE`` +
    ``BLOCK_ALL`` of a bucket.
    """
    rows = split.join(sets.select("id", "shingles"), "id").withColumns(
        {"outs": F.ceil(F.col("outside") / BLOCK_OUTSIDE).cast("int"), "alls": F.ceil(F.col("total") / BLOCK_ALL).cast("int")}
    )
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")
    outside = rows.filter("comp <> largest").select(
        "bucket", (own % F.col("outs")).alias("p"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("q"), "id", "comp", "shingles", F.lit(True).alias("out")
    )
    every = rows.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("p"), (own % F.col("alls")).alias("q"), "id", "comp", "shingles", F.lit(False).alias("out")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block; whole blocks are cut out of the run of batches."""
        rest: pa.Table | None = None

        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([t.column(k).to_numpy() for k in ("bucket", "p", "q")], 1)
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            ids, comp, out = (t.column(k).to_numpy() for k in ("id", "comp", "out"))
            held, pairs = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()], set()
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                outs, alls = low + np.flatnonzero(out[low:high]), low + np.flatnonzero(~out[low:high])
                if len(outs) and len(alls):
                    for i, near in _shared(held, comp, outs, alls, percent):
                        pairs.update((min(int(ids[i]), x), max(int(ids[i]), x)) for x in ids[near].tolist())
            if pairs:
                a, b = zip(*sorted(pairs), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            keys = np.stack([t.column(k).to_numpy() for k in ("bucket", "p", "q")], 1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1))
            end = int(cut[-1]) + 1 if len(cut) else 0
            if end:
                yield from found(t.slice(0, end))
            rest = t.slice(end)
        if rest is not None and rest.num_rows:
            yield from found(rest)

    blocks = outside.unionByName(every).repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")
    return blocks.mapInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row.

    ``size`` words make a shingle; documents whose shingle sets share at least ``percent`` %
    of their union (80 or more) are linked; ``component_id`` is the least id reachable.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for a similarity of 0.8 or more")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialise(sign(docs, "id", "text", size), "signed")
    keyed = signed.filter("set_key IS NOT NULL AND id IS NOT NULL")
    # written, so that the join back deals both sides anew and Spark can split a hot set
    first = materialise(keyed.groupBy("set_key").agg(F.min("id").alias("node")), "first")
    chosen = first.groupBy("node").agg(F.min("set_key").alias("set_key")).withColumnRenamed("node", "id")
    nodes = keyed.join(chosen, ["id", "set_key"]).select("id", "n_shingles", "set_key", "bands")
    nodes = materialise(nodes.dropDuplicates(["id"]), "nodes")
    buckets = nodes.select("id", F.explode("bands").alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    buckets = materialise(buckets.join(crowded, "bucket"), "crowded")
    sets = _sets_of(docs, size, nodes.join(buckets.select("id").distinct(), "id", "left_semi"))
    star = materialise(verify(_star_pairs(buckets), sets, percent), "star")
    labels = components(star)
    release(star)
    for salt in range(ROUNDS):
        split = _split(buckets, labels)
        links = materialise(verify(_sample_pairs(split, salt), sets, percent), "links")
        labels = relabel(labels, links)
        release(split, links)
    split = _split(buckets, labels)
    links = materialise(_outside_links(split, sets, percent), "links")
    if not links.isEmpty():
        labels = relabel(labels, links)
    release(split, links, sets, buckets, nodes)
    where = first.join(labels.withColumnRenamed("id", "node"), "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    rows = signed.select("id", "n_shingles", "set_key").join(where, "set_key", "left")
    alone = F.col("id").isNull() | F.col("set_key").isNull()
    return rows.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates, with the columns it came with."""
    dropped = near_duplicates(docs, id_col, text_col).filter("NOT kept").select(F.col(id_col).alias("dropped")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["dropped"], "left_anti")
