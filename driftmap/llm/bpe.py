"""Byte-level BPE: length-bucketed padded matrices, one leftmost minimum-rank merge per row and round.

Texts are split by a pattern; each piece is merged on its own. New pieces of a slice are
laid out as the rows of padded numpy matrices, bucketed by length. In every round each row
merges its leftmost pair of least rank: the pair's rank comes from a hash table of all
pairs of tokens that join to a token, the row closes up behind the merge, only the two
pairs beside it are looked up again, and finished rows leave the matrix.
In matrices wider than ``WIDE`` a round makes all merges of a row's least rank at once, from
the left, so that rounds are as many as ranks, not as bytes. That gives the same ids if every
token's bytes encode to that token alone, which is checked before the first such matrix: a
merge then never makes a pair of lesser rank, because the bytes of such a pair, which nothing
from outside has touched, would have become its token before. A piece over ``LONG``
bytes alone would hold its matrix for a round over all of it per rank: it goes through an
exact heap over the same pair table. Pieces seen before come from a bounded cache.

Defined results: null and empty texts have no ids; bytes that are not UTF-8 become
replacement characters; ids are packed as little-endian unsigned 32-bit integers; special
tokens are never produced; equal texts, repeated or not, have equal ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, map_texts, slices

WIDE, LONG = 64, 65_536
CACHE_PIECES = 300_000
NONE = np.int32(2**31 - 1)
BUCKETS = (4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512, 1024, 4096, 16_384, LONG)


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _closed(x: np.ndarray, keep: np.ndarray, order: np.ndarray, none) -> np.ndarray:
    """What is kept of each row, moved to the left."""
    out = np.full(order.shape, none, x.dtype)
    out[order] = x[keep]
    return out


class PairTable:
    """Open-addressed hash table from a pair of token ids to the id of their join."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        todo, ids = np.array(keys, np.int64), np.array(values, np.int32)
        slot = self._slot(todo)
        self.depth = 0
        while len(todo):
            self.depth += 1
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            take = first[free[first]]
            self.keys[slot[take]], self.values[slot[take]] = todo[take], ids[take]
            left = np.ones(len(todo), bool)
            left[take] = False
            todo, ids, slot = todo[left], ids[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NONE`` for pairs that do not join, or with an id below 0."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        for _ in range(self.depth):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        out[(left < 0) | (right < 0)] = NONE
        return out


    def one(self, left: int, right: int) -> int | None:
        """Rank of a single pair; None if it does not join."""
        key = left << 32 | right
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (held := int(self.keys[slot])) != key:
            if held == -1:
                return None
            slot = (slot + 1) & ((1 << self.bits) - 1)
        return int(self.values[slot])


class Codec:
    """Encoder and decoder of one rank file and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(ranks)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.cache: dict[str, bytes] = {}
        self.closed: bool | None = None  # every token encodes to itself

    def _check(self) -> None:
        self.closed = False
        own = sorted(self.ranks.items(), key=lambda x: len(x[0]))
        short = [(t, r) for t, r in own if len(t) <= WIDE]
        got = self.merge([t for t, _ in short]) + [self._heap(t) for t, _ in own[len(short) :]]
        self.closed = got == [np.array([r], "<u4").tobytes() for _, r in own]

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        row, done = np.arange(n), [b""] * n
        columns = np.arange(width - 1)
        while len(row):
            at = rank.argmin(1)
            lane = np.arange(len(row))
            best = rank[lane, at]
            over = best == NONE
            if over.any():
                for r, line, size in zip(row[over].tolist(), ids[over], (ids[over] >= 0).sum(1).tolist(), strict=True):
                    done[r] = line[:size].tobytes()
                go = ~over
                row, ids, rank, at, best = row[go], ids[go], rank[go], at[go], best[go]
                if not len(row):
                    break
                lane = np.arange(len(row))
            # close up: what stands right of the merged pair moves one place to the left
            source = columns + (columns > at[:, None])
            tail = np.take_along_axis(ids, source, 1)
            ranks = np.take_along_axis(rank, source, 1)
            ids[:, :-1], ids[:, -1] = tail, -1
            rank[:, :-1], rank[:, -1] = ranks, NONE
            ids[lane, at] = best
            before, after = np.maximum(at - 1, 0), np.minimum(at + 1, width - 1)
            rank[lane, at] = np.where(at + 1 < width, self.pairs.find(best, ids[lane, after]), NONE)
            fresh = self.pairs.find(ids[lane, before], best)
            has = at > 0
            rank[lane[has], before[has]] = fresh[has]
        return done

    def _wide(self, pieces: list[bytes], width: int) -> list[bytes]:
        """As ``_matrix``; a round makes every merge of a row's least rank that does not overlap one to its left."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        row, done = np.arange(n), [b""] * n
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while len(row):
            best = rank.min(1)
            over = best == NONE
            if over.any():
                for r, line, size in zip(row[over].tolist(), ids[over], (ids[over] >= 0).sum(1).tolist(), strict=True):
                    done[r] = line[:size].tobytes()
                row, ids, rank, best = row[~over], ids[~over], rank[~over], best[~over]
                if not len(row):
                    break
            hit = rank == best[:, None]
            before = np.zeros_like(hit)
            before[:, 1:] = hit[:, :-1]
            place = np.arange(hit.shape[1])
            run = np.maximum.accumulate(np.where(hit & ~before, place, 0), axis=1)
            hit &= (place - run) % 2 == 0  # of overlapping pairs every second
            gone = np.zeros_like(hit)
            gone[:, 1:] = hit[:, :-1]
            ids = np.where(hit, best[:, None], ids)
            keep = ~gone & (ids >= 0)
            left = keep.sum(1)
            order = np.arange(int(left.max())) < left[:, None]
            stale = np.zeros_like(hit)  # pairs that a merge is part of, on either side
            stale[:, :-1] = hit[:, :-1] | hit[:, 1:]
            stale[:, -1] = hit[:, -1]
            ids, rank, stale = (_closed(x, keep, order, none) for x, none in ((ids, -1), (rank, NONE), (stale, False)))
            at, col = np.nonzero(stale)
            after = np.where(col + 1 < ids.shape[1], ids[at, np.minimum(col + 1, ids.shape[1] - 1)], -1)
            rank[at, col] = self.pairs.find(ids[at, col], after)
        return done

    def _heap(self, piece: bytes) -> bytes:
        """The same merges, least rank first and leftmost among equals, for a long piece."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.pairs.one
        first = self.pairs.find(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (x := rank(r, ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            if (h := before[i]) >= 0 and (x := rank(ids[h], r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 0
        for width in BUCKETS:
            own = np.flatnonzero((sizes > low) & (sizes <= width)).tolist()
            if width > WIDE and own and self.closed is None:
                self._check()
            merged = self._wide if width > WIDE and self.closed else self._matrix
            for at in range(0, len(own), step := max(1, (1 << 18) // width)):
                part = own[at : at + step]
                for i, x in zip(part, merged([pieces[i] for i in part], width), strict=True):
                    out[i] = x
            low = width
        for i in np.flatnonzero(sizes > low).tolist():
            out[i] = self._heap(pieces[i])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = [self.split(t) for t in texts]
        fresh = list(set().union(*split).difference(self.cache))
        if len(self.cache) + len(fresh) > CACHE_PIECES:
            self.cache.clear()
            fresh = list(set().union(*split))
        self.cache.update(zip(fresh, self.merge([x.encode() for x in fresh]), strict=True))
        look = self.cache.__getitem__
        return [b"".join(map(look, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once a process; every executor reads the file itself."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_column(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids): the packed ids of each whole text."""

    def make() -> Callable:
        own = codec(path, pattern)

        def work(texts: list[bytes]) -> list[pa.Array]:
            ids = own.encode([t.decode("utf-8", "replace") for t in texts])
            return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]

        return work

    kind = df.schema[id_col].dataType.simpleString()
    return map_texts(df, id_col, text_col, f"{id_col} {kind}, n_tokens bigint, ids binary", make, 2 << 20)


def decode_column(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``decoded``: the bytes that the packed ids stand for."""
    at = df.columns.index(ids_col)
    rest = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        own = codec(path, pattern)
        for whole in batches:
            for batch in slices(whole, at, 8 << 20):
                out = pa.array([own.decode(x) for x in as_bytes(batch.column(at))], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, f"{rest}, decoded binary")
