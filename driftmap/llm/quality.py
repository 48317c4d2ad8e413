"""Quality by weak supervision: rules vote or abstain, EM learns how far to trust each.

Every rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0).
Expectation-maximisation over all documents estimates, for either class, how often each
rule casts each vote; a document's posterior probability of being good then replaces the
all-must-pass filter. EM needs only how often each combination of votes occurs, which one
aggregate yields: at most 3 to the number of rules, whatever the number of documents.

Defined results: a null or empty text has no words, and all its counts are 0 but that of
symbols. Equal texts, repeated or not, get equal posteriors, and one exactly at the threshold
is kept. Without any documents the rules keep their starting accuracies.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, as_bytes, word_hashes, shingle_hashes

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_lower", "n_bangs", "n_stops", "n_short_words", "n_echoes",
)
_DROP_FOR_CHARS = bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    keys = shingle_hashes(hashes, window)
    order = np.sort(keys)
    same = order[1:] == order[:-1]
    if not same.any():
        return 0
    hit = np.flatnonzero(np.isin(keys, order[1:][same]))
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def count(text: bytes, hashes: np.ndarray) -> tuple[int, ...]:
    """The counts of one text, in the order of ``FIELDS``."""
    size = len(text)
    if not len(hashes):
        return (0, 0, size - len(text.translate(None, SYMBOLS)), *[0] * (len(FIELDS) - 3))
    seen, lines, dups = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dups += line in seen
            seen.add(line)
    words = text.split()
    return (
        len(words),
        len(text.translate(None, _DROP_FOR_CHARS)),
        size - len(text.translate(None, SYMBOLS)),
        dups,
        repeated_words(hashes),
        lines,
        size - len(text.translate(None, _UPPER)),
        size - len(text.translate(None, _LOWER)),
        text.count(b"!"),
        text.count(b"."),
        sum(1 for w in words if len(w) <= 3 and (w[:1].isalnum() or w[:1] >= b"\x80")),
        int((hashes[1:] == hashes[:-1]).sum()),
    )


def _counted(col: pa.Array) -> pa.Array:
    texts, rows, at = as_bytes(col), [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < SLICE_BYTES):
            size += len(texts[end])
            end += 1
        hashes, bounds = word_hashes(texts[at:end], lower=False)
        rows += [count(texts[at + i], hashes[bounds[i] : bounds[i + 1]]) for i in range(end - at)]
        at = end
    table = np.array(rows, np.int64).reshape(-1, len(FIELDS))
    return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(FIELDS))], list(FIELDS))


def features(text: Column) -> Column:
    """A struct of the counts ``FIELDS`` of a whole text."""
    udf = F.arrow_udf(_counted, f"struct<{', '.join(f'{x}:bigint' for x in FIELDS)}>").asNondeterministic()
    return udf(text)


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` take a function that gives a count's column by name."""

    name: str
    bad: Callable[[Callable[[str], Column]], Column]
    good: Callable[[Callable[[str], Column]], Column]

    def vote(self, c: Callable[[str], Column]) -> Column:
        return F.when(self.bad(c), F.lit(-1)).when(self.good(c), F.lit(1)).otherwise(F.lit(0))


def _per(c: Callable[[str], Column], top: str, under: str = "n_words") -> Column:
    return c(top) / F.greatest(c(under), F.lit(1))


def _never(c: Callable[[str], Column]) -> Column:
    return F.lit(False)


RULES = (
    Rule("symbols", lambda c: _per(c, "n_symbols") > 0.1, _never),
    Rule("capitals", lambda c: (c("n_words") >= 3) & (c("n_upper") > c("n_lower")), _never),
    Rule("exclamations", lambda c: _per(c, "n_bangs") > 0.2, _never),
    Rule("repeats", lambda c: _per(c, "n_repeat_words") > 0.3, _never),
    Rule("lines", lambda c: (c("n_dup_lines") >= 3) & (_per(c, "n_dup_lines", "n_lines") > 0.3), _never),
    Rule("word_length", lambda c: (c("n_words") >= 5) & ((_per(c, "word_chars") > 10) | (_per(c, "word_chars") < 2)), _never),
    Rule("short_words", lambda c: (c("n_words") >= 20) & (_per(c, "n_short_words") < 0.12), lambda c: (c("n_words") >= 5) & (_per(c, "n_short_words") > 0.25)),
    Rule("echoes", lambda c: (c("n_words") >= 20) & (_per(c, "n_echoes") > 0.1), _never),
    Rule("sentences", lambda c: (c("n_words") >= 20) & (_per(c, "n_stops") < 0.02), lambda c: (c("n_words") >= 5) & _per(c, "n_stops").between(0.03, 0.4)),
    Rule("length", lambda c: c("n_words") == 0, _never),
)
#: A rule's bad vote is taken to befall at most this share of good documents. Without the bound a
#: rule that alone finds one kind of junk would pass for a trait of good documents.
MOST_FALSE = 0.02


@dataclass
class Model:
    """Prior odds and, for each rule and vote (-1, 0, 1), the logarithm of the classes' ratio."""

    prior: float
    weights: np.ndarray
    accuracies: np.ndarray
    rules: tuple[Rule, ...]

    def posterior(self, c: Callable[[str], Column]) -> Column:
        """Probability of being good, from the columns of a row's counts."""
        odds = F.lit(float(np.log(self.prior / (1 - self.prior))))
        for rule, w in zip(self.rules, self.weights.tolist(), strict=True):
            vote = rule.vote(c)
            odds = odds + F.when(vote == -1, F.lit(w[0])).when(vote == 1, F.lit(w[2])).otherwise(F.lit(w[1]))
        return 1 / (1 + F.exp(-odds))


def em(votes: np.ndarray, counts: np.ndarray, rules: tuple[Rule, ...], rounds: int = 300) -> Model:
    """Expectation-maximisation over combinations of votes (rows of 0 bad, 1 abstain, 2 good)."""
    n = votes.shape[1]
    start = np.array([[[0.3, 0.6, 0.1], [0.01, 0.49, 0.5]]]).repeat(n, 0)  # rule, class, vote
    for j in range(n):
        if not (votes[:, j] == 2).any():
            start[j] = [[0.3, 0.699, 0.001], [0.01, 0.989, 0.001]]
    table, prior, smooth = start.copy(), 0.8, 2.0
    for _ in range(rounds if len(counts) else 0):
        log = np.log(np.array([1 - prior, prior])) + sum(np.log(table[j][:, votes[:, j]].T) for j in range(n))
        p = np.exp(log - log.max(1, keepdims=True))
        p = p / p.sum(1, keepdims=True) * counts[:, None]
        fresh = np.stack([np.stack([p[votes[:, j] == v].sum(0) for v in range(3)], 1) + smooth * start[j] for j in range(n)])
        fresh /= fresh.sum(2, keepdims=True)
        for j in np.flatnonzero(fresh[:, 1, 0] > MOST_FALSE).tolist():
            fresh[j, 1, 1:] *= (1 - MOST_FALSE) / (1 - fresh[j, 1, 0])
            fresh[j, 1, 0] = MOST_FALSE
        ahead = float((p[:, 1].sum() + 0.8 * smooth) / (counts.sum() + smooth))
        moved = max(abs(fresh - table).max(), abs(ahead - prior))
        table, prior = fresh, ahead
        if moved < 1e-7:
            break
    weights = np.log(table[:, 1]) - np.log(table[:, 0])
    right = prior * table[:, 1, 2] + (1 - prior) * table[:, 0, 0]
    cast = right + prior * table[:, 1, 0] + (1 - prior) * table[:, 0, 2]
    return Model(prior, weights, right / cast, rules)


def fit(counted: DataFrame, struct: str | None = None, rules: tuple[Rule, ...] = RULES) -> Model:
    """Estimate the rules' accuracies from all rows of counts."""
    c = (lambda x: F.col(f"{struct}.{x}")) if struct else F.col
    code = sum(((rule.vote(c) + 1) * 3**j for j, rule in enumerate(rules)), F.lit(0)).alias("code")
    rows = counted.select(code).groupBy("code").count().collect()  # at most 3 ** len(rules)
    codes = np.array(sorted((r["code"], r["count"]) for r in rows), np.int64).reshape(-1, 2)
    votes = codes[:, :1] // 3 ** np.arange(len(rules)) % 3
    return em(votes, codes[:, 1].astype(float), rules)


def base_failed(c: Callable[[str], Column]) -> Column:
    return (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))


def filter_documents(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose posterior reaches ``threshold``, with the columns they came with.

    Two passes over the texts, one for the rules' accuracies; nothing else is kept between.
    """
    model = fit(docs.select(features(F.col(text_col)).alias("f")), "f")
    name = "f"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, features(F.col(text_col)))
    return rows.filter(model.posterior(lambda x: F.col(f"{name}.{x}")) >= threshold).drop(name)
