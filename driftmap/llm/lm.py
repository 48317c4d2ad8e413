"""Document scoring by a gated recurrent language model with a class-factored softmax.

Tokens are lower-cased words and one end mark a document. Counts of all tokens of all
training documents give the vocabulary: the most frequent words that make up
``MODEL_TOKENS`` of all tokens, up to ``MODEL_MOST`` words, have embeddings and outputs of
their own, dealt by frequency into classes (``class_edges``); every other word belongs to one
more class, whose inner distribution is the add-one count of the word among them.
P(word | past) = P(class | state) P(word | class, state), so each step needs two short
softmaxes rather than one over the vocabulary, and unseen words keep some mass.

Training is truncated backpropagation through time in numpy: a short warm-up on a bounded
sample (``WARM_DOCUMENTS``), then a pass over all tokens of all training documents, task by
task. Every task starts from the warm parameters, and the results are averaged by the tokens
they have seen, in any order; so a score depends a little on how the input is split into
tasks, and for a given split is the same but for the rounding of sums. Training and scoring
run over whole documents: lanes of many documents side by side, window after window, the
state carried from one to the next, and the end mark before a document's first word only.

Counts of the ``HEAD_COUNTS`` most frequent words travel to the executors, and of all
modelled words if those are more; none of them has more than ``HEAD_BYTES`` bytes, which
bounds what travels. All other words are joined word by word, by Spark.

Ids are integers (others are read as null). Defined results: a null or empty text is one end
mark; repeated rows are scored each, and equal texts of one task alike; without training
documents every count is 0 and the model is its random start.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc32_of_id, materialise, slices

HEAD_COUNTS, HEAD_BYTES = 400_000, 64
MODEL_TOKENS, MODEL_MOST = 0.8, 1_000_000
HIDDEN = 20
WINDOW, TRAIN_WINDOW, LANES, TRAIN_LANES = 32, 16, 512, 1024
WARM_DOCUMENTS, WARM_PASSES = 400, 2
STRETCH = 16
BLOCK, ROOM = 1024, 40_000  # rows of a softmax that are computed together, and their logits: small products are the fastest
CHUNK = 8192  # parameters that move together
SLAB = 3_000_000  # tokens that a task lays out side by side
FLUSH_WORDS = 300_000
END = b""  # the end mark: no word is empty
LN10, LN2 = float(np.log(10)), float(np.log(2))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


# --- counts ----------------------------------------------------------------------------


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, n) over the column ``text``; each task adds up its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                held.update(words_of(text))
                held[END] += 1
                if len(held) > FLUSH_WORDS:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent words, most frequent first, and what all words add up to."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int  # N
    distinct: int  # V
    model_words: int

    def __post_init__(self) -> None:
        self.known = min(self.model_words, len(self.words))
        self.tail_tokens = self.tokens - int(self.counts[: self.known].sum())
        self.tail_distinct = self.distinct - self.known
        self.log_base = float(np.log10(self.tokens + self.distinct + 1))
        self.log_tail = float(np.log10(self.tail_tokens + self.tail_distinct + 1))

    @property
    def index(self) -> dict[bytes, int]:
        return self.first(len(self.words))

    def first(self, n: int) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words[:n])}


def vocabulary(counts: DataFrame, head: int = HEAD_COUNTS, model_words: int | None = None) -> Vocabulary:
    """The words above the least count that at most ``head`` words reach, or all modelled words.

    Modelled are ``model_words`` words, or those of the highest counts with ``MODEL_TOKENS`` of all tokens.
    """
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()  # distinct counts: under sqrt(2 N)
    levels = sorted(((r["n"], r["k"]) for r in levels), reverse=True)
    tokens, distinct = sum(n * k for n, k in levels), sum(k for _, k in levels)
    if model_words is None:
        model_words, held = 0, 0
        for n, k in levels:
            if held >= MODEL_TOKENS * tokens or model_words + k > MODEL_MOST:
                break
            model_words, held = model_words + k, held + n * k
        head = max(head, model_words)
    least, taken = (levels[0][0] + 1 if levels else 1), 0
    for n, k in levels:
        if taken + k > head:
            break
        least, taken = n, taken + k
    top = counts.filter((F.col("n") >= least) & (F.octet_length("word") <= HEAD_BYTES)).toArrow()
    words, ns = as_bytes(top.column("word").combine_chunks()) if top.num_rows else [], top.column("n").to_pylist()
    order = sorted(range(len(words)), key=lambda i: (-ns[i], words[i]))
    return Vocabulary([words[i] for i in order], np.array([ns[i] for i in order], np.int64), tokens, distinct, model_words)


# --- the network -----------------------------------------------------------------------


def class_edges(counts: np.ndarray, tokens: int) -> np.ndarray:
    """Where classes of words begin, and the last one ends; words come most frequent first.

    A step computes every class and every word of one class, so a class is as wide as its share
    of the tokens allows: share times width is about the same for all, at the level that makes
    an average step the cheapest. Equally frequent words make classes of their square root.
    """
    known = len(counts)
    share = np.concatenate([[0.0], np.cumsum(counts / max(1, tokens))])

    def cut(level: float) -> list[int]:
        edges = [0]
        while edges[-1] < known:
            a, low, high = edges[-1], edges[-1] + 1, known
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if (share[middle] - share[a]) * (middle - a) <= level else (low, middle - 1)
            edges.append(low)
        return edges

    def price(edges: list[int]) -> float:
        return len(edges) - 1 + float((np.diff(edges) * np.diff(share[edges])).sum())

    return np.array(min((cut(2.0**k) for k in np.arange(-5, 4, 0.5)), key=price), np.int64)


SAFE = 50.0  # logits up to here need no shift before the exponential


@dataclass
class Network:
    """Parameters by name; ``known`` words of their own, one more input for all others."""

    known: int
    hidden: int = HIDDEN
    class_words: int = 0  # words a class, about the square root of ``known``, where no edges are given
    edges: np.ndarray | None = None
    p: dict[str, np.ndarray] = field(default_factory=dict)
    seen: int = 0  # tokens of the pass over all training documents
    safe: bool = False
    held: dict[str, np.ndarray] = field(default_factory=dict, repr=False)  # memory that windows use again

    def __post_init__(self) -> None:
        if self.edges is None:
            each = self.class_words or max(1, round(self.known**0.5))
            self.edges = np.append(np.arange(0, self.known, each), self.known)
        self.classes = len(self.edges)  # the last holds all other words
        self.class_of = np.append(np.repeat(np.arange(self.classes - 1), np.diff(self.edges)), self.classes - 1)
        self.class_of = self.class_of.astype(np.uint16 if self.classes < 1 << 16 else np.int64)
        if self.p:
            return
        r, h, k = np.random.default_rng(3), self.hidden, self.known
        make = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
        self.p = {"embed": make(k + 1, h), "wx": make(h, 3 * h) * 3, "wh": make(h, 3 * h) * 3, "b": np.zeros(3 * h, np.float32)}
        # outputs, a row for each class and each word: weights, then the offset
        offsets = lambda w: np.ascontiguousarray(np.column_stack([w, np.zeros(len(w), np.float32)]))
        self.p |= {"wc": offsets(make(h, self.classes).T), "wo": offsets(make(k + 1, h))}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array of any contents, in the memory that the last one of this name had."""
        size, kind = int(np.prod(shape)), self.p["wh"].dtype
        if name not in self.held or self.held[name].size < size or self.held[name].dtype != kind:
            self.held[name] = np.empty(size, kind)
        return self.held[name][:size].reshape(shape)

    @staticmethod
    def of(v: Vocabulary) -> Network:
        """A network for the modelled words, its output offsets at the logarithms of the counts."""
        net = Network(v.known, edges=class_edges(v.counts[: v.known], v.tokens))
        if v.known:
            net.p["wo"][: v.known, -1] = np.log(v.counts[: v.known] + 1.0) - np.log(v.tokens + 1)
            mass = np.add.reduceat(v.counts[: v.known], net.edges[:-1])
            net.p["wc"][:, -1] = np.log(np.append(mass, v.tail_tokens) + 1.0) - np.log(v.tokens + 1)
        return net

    def check(self) -> None:
        """Set ``safe``: states are within 1, so that the weights bound every logit."""
        self.safe = max(float(np.abs(self.p[k]).sum(1).max(initial=0)) for k in ("wc", "wo")) < SAFE

    def inputs(self) -> np.ndarray:
        """What a step multiplies (state, embedding, 1) by, once for parameters that no longer change.

        Rows: the new state's part of the state; the two gates, halved for ``tanh``; its part of the input.
        """
        p, n = self.p, self.hidden
        w = np.zeros((4 * n, 2 * n + 1), p["wh"].dtype)
        w[:n, :n] = p["wh"][:, 2 * n :].T
        w[n : 3 * n, :n] = p["wh"][:, : 2 * n].T
        w[n:, n : 2 * n], w[n:, 2 * n] = p["wx"].T, p["b"]
        w[n : 3 * n] /= 2
        return w

    def forward(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, table: np.ndarray | None = None, keep: bool = False):
        """States (time, lane, hidden) for inputs (time, lane); ``fresh`` marks documents' starts.

        Within, lanes come last, so that gates are whole rows.
        """
        n, (steps, lanes) = self.hidden, x.shape
        w = self.inputs() if table is None else table
        out = np.empty((steps, lanes, n), w.dtype)
        kept = steps if keep else 1
        given, made = self.room("given", kept, 2 * n + 1, lanes), self.room("made", kept, 4 * n, lanes)
        given[:, 2 * n] = 1
        own, free = np.empty((lanes, n), w.dtype), np.empty((n, lanes), w.dtype)
        h, starts = h.T.copy(), fresh.any(1).tolist()
        for t in range(steps):
            g, m = given[t % kept], made[t % kept]
            g[:n] = h
            if starts[t]:
                g[:n] *= ~fresh[t]
            np.take(self.p["embed"], x[t], axis=0, out=own, mode="clip")
            g[n : 2 * n] = own.T
            np.matmul(w, g, out=m)
            gates, new = m[n : 3 * n], m[3 * n :]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new += np.multiply(gates[:n], m[:n], out=free)
            np.tanh(new, out=new)
            np.subtract(g[:n], new, out=h)
            h *= gates[n:]
            h += new
            out[t] = h.T
        return out, h.T, (given, made) if keep else None

    def log_probs(self, states: np.ndarray, y: np.ndarray, grad: bool = False):
        """Natural log-probability of each target (``known``: some other word, its class only).

        With ``grad``: also the gradients of the negative mean, for states and outputs.
        Rows go in order of class and in blocks that stay in the cache, powers are of two; a column of ones carries the offsets.
        """
        p, n, rows = self.p, self.hidden, len(y)
        order = np.argsort(self.class_of[y], kind="stable")
        y = y[order]
        cls = self.class_of[y]
        s = np.empty((rows, n + 1), states.dtype)
        np.take(states, order, axis=0, out=s[:, :n], mode="clip")
        s[:, n] = 1
        across = np.multiply(s.T, 1 / LN2, order="C", dtype=s.dtype)
        scale = s.dtype.type(1 / max(1, rows))
        room, count = np.empty(max(ROOM, BLOCK), s.dtype), np.arange(BLOCK)
        logs, sums = np.zeros(rows, s.dtype), np.empty((n + 1, rows), s.dtype)

        def softmax(w: np.ndarray, first: int, last: int, at: np.ndarray, slope: np.ndarray | None) -> None:
            """Logarithms of the sums of rows first to last to ``logs``; with ``grad``, weighted sums of ``w`` and the slopes for it too."""
            width = len(w)
            each = min(BLOCK, max(1 + ROOM // 1024, ROOM // width))
            if grad:
                add = np.empty((n + 1, width), s.dtype)  # the last row adds up
                add[:n], add[n] = w[:, :n].T, 1
            for a in range(first, last, each):
                b = min(a + each, last)
                k = b - a
                e = room[: k * width].reshape(width, k) if k * width <= len(room) else np.empty((width, k), s.dtype)
                np.matmul(w, across[:, a:b], out=e)
                if not self.safe:
                    most = e.max(0)
                    e -= most
                    logs[a:b] += most
                np.exp2(e, out=e)
                if not grad:
                    logs[a:b] += np.log2(ones[:width] @ e)
                    continue
                np.matmul(add, e, out=sums[:, a:b])
                total = sums[n, a:b]
                e[at[a - first : b - first], count[:k]] -= total
                by = s[a:b] * (scale / total)[:, None]
                if a == first:
                    np.matmul(e, by, out=slope)
                else:
                    slope += e @ by

        def weigh(w: np.ndarray) -> None:
            """What the sums give for ``logs`` and states; ``w``: rows of the targets."""
            nonlocal back
            if grad:
                logs[:] += np.log2(sums[n])
                sums[:n] *= scale / sums[n]
                back += sums[:n].T
                back -= scale * w[:, :n]

        edges, cuts = self.edges.tolist(), np.searchsorted(cls, np.arange(self.classes)).tolist()
        ones = np.ones(max(self.classes, int(np.diff(self.edges).max(initial=1))), s.dtype)
        g = {k: np.empty_like(p[k]) for k in ("wc", "wo")} if grad else {"wc": None}
        if grad and not rows:
            g["wc"][:] = 0
        back = np.zeros((rows, n), s.dtype)
        own = np.take(p["wc"], cls, axis=0, mode="clip")
        lp = np.einsum("ij,ij->i", own, s)
        softmax(p["wc"], 0, rows, cls, g["wc"])
        weigh(own)
        own = np.take(p["wo"], y, axis=0, mode="clip")
        sums[:n], sums[n] = 0, 1
        for c in range(self.classes):
            a, b = cuts[c], cuts[c + 1] if c + 1 < self.classes else rows
            low, high = edges[c], edges[c + 1] if c + 1 < self.classes else self.known + 1
            if a == b or high - low == 1:  # a class of one word is that word
                own[a:b] = 0
                if grad:
                    g["wo"][low:high] = 0
                continue
            softmax(p["wo"][low:high], a, b, y[a:b] - low, g["wo"][low:high] if grad else None)
        weigh(own)
        lp += np.einsum("ij,ij->i", own, s)
        logs *= LN2
        lp -= logs
        out = np.empty_like(lp)
        out[order] = lp
        if grad:
            g["states"] = np.empty_like(states)
            g["states"][order] = back
        return (out, g) if grad else out

    def gradients(self, x, y, valid, fresh, h):
        """Mean gradients of one window, its mean loss and the state behind it.

        That of the embeddings is a pair: the words that occur, and their rows.
        """
        p, n = self.p, self.hidden
        states, after, (given, made) = self.forward(x, fresh, h, keep=True)
        if valid.all():
            lp, g = self.log_probs(states.reshape(-1, n), y.ravel(), grad=True)
            d_states = g.pop("states").reshape(states.shape)
        else:
            lp, g = self.log_probs(states[valid], y[valid], grad=True)
            d_states = np.zeros_like(states)
            d_states[valid] = g.pop("states")
        wx, wh = np.ascontiguousarray(p["wx"].T), np.concatenate([p["wh"][:, 2 * n :], p["wh"][:, : 2 * n]], 1)
        d = np.empty((n, x.shape[1]), states.dtype)
        left, free, d_h, own = np.empty_like(d), np.empty_like(d), np.zeros_like(d), self.room("own", 4 * n, x.shape[1])
        d_new = own[3 * n :]
        total, rows = np.zeros((4 * n, 2 * n + 1), states.dtype), self.room("rows", *states.shape)
        starts = fresh.any(1).tolist()
        for t in range(len(x) - 1, -1, -1):
            before, (un, r, z, new) = given[t, :n], made[t].reshape(4, n, -1)
            np.add(d_h, d_states[t].T, out=d)
            np.subtract(1, z, out=left)
            np.multiply(new, new, out=free)
            np.subtract(1, free, out=free)
            free *= left
            np.multiply(d, free, out=d_new)
            np.multiply(d_new, r, out=own[:n])
            np.subtract(1, r, out=free)
            free *= un
            np.multiply(own[:n], free, out=own[n : 2 * n])
            d *= z
            np.subtract(before, new, out=free)
            free *= left
            np.multiply(d, free, out=own[2 * n : 3 * n])
            np.matmul(wh, own[: 3 * n], out=d_h)
            d_h += d
            if starts[t]:
                d_h *= ~fresh[t]
            total += own @ given[t].T
            np.matmul(own[n:].T, wx, out=rows[t])
        g["wh"] = np.concatenate([total[n : 3 * n, :n], total[:n, :n]]).T
        g["wx"], g["b"] = total[n:, n : 2 * n].T, total[n:, 2 * n]
        flat_x = x.ravel()
        order = np.argsort(flat_x)
        in_order = flat_x[order]
        first = np.flatnonzero(np.diff(in_order, prepend=-1))
        g["embed"] = (in_order[first], np.add.reduceat(np.take(rows.reshape(-1, n), order, axis=0, mode="clip"), first, axis=0))
        return g, -float(lp.sum()) / max(1, len(lp)), after


def lanes_of(lengths: list[int], lanes: int) -> list[list[int]]:
    """Documents dealt to lanes of nearly equal length, the longest lane first."""
    import heapq

    n = max(1, min(lanes, len(lengths)))
    heap, out = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        size, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (size + lengths[d], i))
    return sorted((x for x in out if x), key=lambda own: -sum(lengths[d] for d in own))


def windows(ids: list[np.ndarray], end: int, lanes: int, window: int):
    """(x, y, valid, fresh, document) of each window, (time, lane); lanes that have ended are left out.

    ``ids`` are documents with their end mark; the mark also stands before the first word.
    Lanes are stretches of one flat array, so memory is that of the tokens, whatever their lengths.
    Where few lanes are left, windows are longer, up to ``STRETCH`` times.
    """
    if not ids:
        return
    dealt = lanes_of([len(x) for x in ids], lanes)
    order = [d for own in dealt for d in own]
    sizes = np.array([len(ids[d]) for d in order])
    y_all = np.concatenate([ids[d] for d in order])
    begins = np.cumsum(sizes) - sizes
    first = np.zeros(len(y_all), bool)
    first[begins] = True
    x_all = np.empty_like(y_all)
    x_all[1:] = y_all[:-1]
    x_all[begins] = end
    doc_all = np.repeat(np.array(order, np.int32), sizes)
    lengths = np.array([sum(len(ids[d]) for d in own) for own in dealt])
    starts = np.cumsum(lengths) - lengths
    t, last = 0, int(lengths[0])
    while t < last:
        live = int((lengths > t).sum())
        steps = np.arange(t, min(t + window * min(STRETCH, max(1, len(dealt) // live)), last))[:, None]
        t += len(steps)
        valid = steps < lengths[None, :live]
        at = np.where(valid, starts[None, :live] + steps, starts[None, :live])
        yield x_all[at], y_all[at], valid, first[at] & valid, doc_all[at]


class Adagrad:
    """Steps that shrink with what a parameter has already moved; embeddings move where words occur."""

    def __init__(self, p: dict[str, np.ndarray], rate: float = 0.1) -> None:
        self.p, self.rate = p, np.float32(rate)
        self.sums = {k: np.full_like(v, 1e-8) for k, v in p.items()}

    def step(self, g: dict) -> None:
        for k, x in g.items():
            if isinstance(x, tuple):
                own, x = x
                s = np.take(self.sums[k], own, axis=0) + x * x
                self.sums[k][own] = s
                self.p[k][own] -= self.rate * x / np.sqrt(s)
                continue
            flat, own, sums = np.ravel(x), self.p[k].reshape(-1), self.sums[k].reshape(-1)
            room = np.empty(min(CHUNK, len(flat)), flat.dtype)
            for a in range(0, len(flat), CHUNK):  # what stays in the cache
                x, s = flat[a : a + CHUNK], sums[a : a + CHUNK]
                move = np.multiply(x, x, out=room[: len(x)])
                s += move
                np.sqrt(s, out=move)
                np.divide(x, move, out=move)
                move *= self.rate
                own[a : a + CHUNK] -= move


def train(net: Network, ids: list[np.ndarray], end: int, steps: Adagrad) -> tuple[float, int]:
    """One pass over documents; the summed loss and the tokens seen."""
    loss, seen, h = 0.0, 0, None
    net.check()
    for x, y, valid, fresh, _ in windows(ids, end, TRAIN_LANES, TRAIN_WINDOW):
        h = np.zeros((x.shape[1], net.hidden), np.float32) if h is None else h[: x.shape[1]]
        g, mean, h = net.gradients(x, y, valid, fresh, h)
        steps.step(g)
        loss, seen = loss + mean * int(valid.sum()), seen + int(valid.sum())
    return loss, seen


def score(net: Network, ids: list[np.ndarray], end: int, table: np.ndarray | None = None) -> np.ndarray:
    """Natural log-probability of each document; ``table``: the network's ``inputs()``, if at hand."""
    out, h = np.zeros(len(ids)), None
    for x, y, valid, fresh, doc in windows(ids, end, LANES, WINDOW):
        h = np.zeros((x.shape[1], net.hidden), np.float32) if h is None else h[: x.shape[1]]
        states, h, _ = net.forward(x, fresh, h, table)
        lp = net.log_probs(states[valid], y[valid])
        out += np.bincount(doc[valid], weights=lp.astype(np.float64), minlength=len(ids))
    return out


# --- training and scoring with Spark ---------------------------------------------------


class _Indexed:
    """The vocabulary's index, built once a Python worker from the broadcast words.

    The vocabulary is held with its index: an address alone could come to be another's.
    """

    held: dict[bool, tuple[Vocabulary, dict[bytes, int]]] = {}

    @classmethod
    def of(cls, shared, modelled: bool = False) -> tuple[Vocabulary, dict[bytes, int]]:
        """All words that travel, or with ``modelled`` only those that training tells apart."""
        v = shared.value
        if modelled not in cls.held or cls.held[modelled][0] is not v:
            cls.held[modelled] = (v, v.first(v.known) if modelled else v.index)
        return cls.held[modelled]


def _ranks(words: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words))


def _known(ranks: np.ndarray, known: int, end: int) -> np.ndarray:
    """Inputs and targets of a document: modelled words, one id for all others, the end mark."""
    out = np.empty(len(ranks) + 1, np.int32)
    out[:-1] = np.where((ranks < 0) | (ranks >= known), known, ranks)
    out[-1] = end
    return out


def _ids(words: list[bytes], index: dict[bytes, int], v: Vocabulary, end: int) -> np.ndarray:
    return _known(_ranks(words, index), v.known, end)


def _end(v: Vocabulary, index: dict[bytes, int]) -> int:
    at = index.get(END, v.known)
    return min(at, v.known)


def learn(train_docs: DataFrame, v: Vocabulary, shared) -> Network:
    """A network trained on the column ``text`` of all rows (``key``: a hash of the row)."""
    net = Network.of(v)
    documents = int(v.counts[v.words.index(END)]) if END in v.words else 0
    if not documents:
        return net
    limit = min(1.0, WARM_DOCUMENTS / documents)
    warm = train_docs.filter(F.pmod("key", F.lit(1 << 40)) < limit * float(1 << 40))

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, index = _Indexed.of(shared, modelled=True)
        end = _end(v, index)
        for batch in batches:
            rows = [_ids(words_of(t), index, v, end) for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tobytes() for x in rows], pa.binary())], names=["key", "ids"])

    sample = warm.select("text", "key").mapInArrow(to_ids, "key bigint, ids binary").collect()  # about WARM_DOCUMENTS
    sample = [np.frombuffer(r["ids"], np.int32) for r in sorted(sample, key=lambda r: (r["key"], bytes(r["ids"])))]
    end, steps = _end(v, v.index), Adagrad(net.p)
    for _ in range(WARM_PASSES):
        train(net, sample, end, steps)
    begun = train_docs.sparkSession.sparkContext.broadcast(pickle.dumps(steps))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, index = _Indexed.of(shared, modelled=True)
        steps: Adagrad = pickle.loads(begun.value)
        own = Network(v.known, edges=class_edges(v.counts[: v.known], v.tokens), p=steps.p)
        end, seen, held, size = _end(v, index), 0, [], 0

        def fit() -> None:
            nonlocal seen, held, size
            seen, held, size = seen + train(own, held, end, steps)[1], [], 0

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                held.append(_ids(words_of(text), index, v, end))
                size += len(held[-1])
                if size > SLAB:
                    fit()
        if held:
            fit()
        if seen:
            flat = np.concatenate([own.p[k].ravel() for k in sorted(own.p)]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([flat.tobytes()], pa.binary())], names=["seen", "flat"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, flat = 0, None
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                x = np.frombuffer(x)
                seen, flat = seen + n, x.copy() if flat is None else flat + x
        if flat is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([flat.tobytes()], pa.binary())], names=["seen", "flat"])

    parts = train_docs.select("text").mapInArrow(local, "seen bigint, flat binary")
    several = parts.rdd.getNumPartitions()
    while True:  # sums meet in a tree, eight at a time; once at least, so that all tasks of the pass run together
        several = -(-several // 8)
        parts = parts.repartition(max(1, several)).mapInArrow(add, "seen bigint, flat binary")
        if several <= 8:
            break
    total, flat = 0, None
    for r in parts.toLocalIterator():  # one set of parameters at a time
        x = np.frombuffer(r["flat"])
        total, flat = total + r["seen"], x.copy() if flat is None else flat + x
    net.seen = total
    if flat is not None:
        at = 0
        for k in sorted(net.p):
            size = net.p[k].size
            net.p[k] = (flat[at : at + size] / total).astype(np.float32).reshape(net.p[k].shape)
            at += size
    net.check()
    return net


SCORED = "row bigint, word binary, tf bigint, id bigint, n_tokens bigint, n_known bigint, lc double, tail bigint, lp double"


def score_documents(docs: DataFrame, held_out: Callable[[str], Column], id_col: str = "doc_id", text_col: str = "text", head: int = HEAD_COUNTS, model_words: int | None = None) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``held_out`` gives, for the name of an id column, whether a row is kept from learning.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    learning = rows.filter(~F.col("held_out"))
    counts = materialise(count_tokens(learning), "counts")
    v = vocabulary(counts, head, model_words)
    shared = spark.sparkContext.broadcast(v)
    net = learn(learning, v, shared)
    frozen = spark.sparkContext.broadcast(pickle.dumps(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, index = _Indexed.of(shared)
        own: Network = pickle.loads(frozen.value)
        table, end = own.inputs(), _end(v, index)
        log_count = np.log10(np.append(v.counts, 0) + 1.0)
        end_log = float(log_count[index.get(END, -1)])
        at = TaskContext.get().partitionId() << 36
        held, ids, stats, size = [], [], [], 0  # documents' own rows; the words that are not here leave at once

        def scored() -> pa.RecordBatch:
            nonlocal held, ids, stats, size, at
            n = len(held)
            lp = score(own, ids, end, table) / LN10
            mark = np.arange(at, at + n)
            s = np.array(stats, np.float64).reshape(-1, 5)
            none = pa.nulls(n, pa.int64())
            out = [
                pa.array(mark), pa.array([b" %d" % m for m in mark.tolist()], pa.binary()), none, pa.array(held, pa.int64()), pa.array(s[:, 0].astype(np.int64)),
                pa.array(s[:, 1].astype(np.int64)), pa.array(s[:, 2] + s[:, 3]), pa.array(s[:, 4].astype(np.int64)), pa.array(lp + s[:, 3]),
            ]
            held, ids, stats, size, at = [], [], [], 0, at + n
            return pa.RecordBatch.from_arrays(out, names=SCORED_NAMES)

        for whole in batches:
            for batch in slices(whole, 1):
                rare, marks = [], at + len(held)
                for i, text in enumerate(as_bytes(batch.column(1))):
                    words = words_of(text)
                    got = _ranks(words, index)
                    ids.append(_known(got, v.known, end))
                    missing = [words[j] for j in np.flatnonzero(got < 0).tolist()]
                    in_tail = got >= v.known
                    tail_log = float(log_count[got[in_tail]].sum())
                    own_log = float(log_count[got[(got >= 0) & ~in_tail]].sum()) + end_log
                    stats.append((len(words) + 1, len(words) - len(missing) + (END in index), own_log, tail_log, int(in_tail.sum()) + len(missing) + (END not in index)))
                    size += len(words) + 1
                    rare += [(marks + i, w, n) for w, n in Counter(missing).items()]
                held += batch.column(0).to_pylist()
                if rare:
                    whole_, real = pa.nulls(len(rare), pa.int64()), pa.nulls(len(rare), pa.float64())
                    first = [pa.array([x[k] for x in rare], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*first, whole_, whole_, whole_, real, whole_, real], names=SCORED_NAMES)
                if size > SLAB:
                    yield scored()
        if held:
            yield scored()

    # a document's own row has a key that no word can equal, so that all rows spread over the join
    scored = rows.select("id", "text").mapInArrow(run, SCORED)
    rest = counts.select("word", "n")
    joined = scored.join(rest, "word", "left")
    more = F.when(F.col("tf").isNotNull(), F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 1.0))
    seen = F.when(F.col("tf").isNotNull() & F.col("n").isNotNull(), F.col("tf"))
    by_row = joined.groupBy("row").agg(
        F.max("id").alias("id"), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + F.coalesce(F.sum(seen), F.lit(0))).alias("n_known"),
        F.coalesce(F.sum(more), F.lit(0.0)).alias("more"), F.max("lc").alias("lc"), F.max("tail").alias("tail"), F.max("lp").alias("lp"),
    )
    return by_row.select(
        F.col("id").alias(id_col),
        F.coalesce(held_out("id"), F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("lc") + F.col("more") - F.col("n_tokens") * v.log_base).alias("base_score"),
        (F.col("lp") + F.col("more") - F.col("tail") * v.log_tail).alias("score"),
    )


SCORED_NAMES = [x.split()[0] for x in SCORED.split(", ")]


def held_out_column(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 on division by 7."""
    return crc32_of_id(F.col(id_col)) % 7 == 2
