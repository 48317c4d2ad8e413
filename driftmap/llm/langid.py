"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Lower-cased whole texts give counts of 1- to 3-grams of code points, hashed to ``DIM``
features. Document frequencies cover all training documents. Weights are trained by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled
rows (``SAMPLE_ROWS``, dealt evenly over languages by a hash of the id), and a temperature
fitted on a fifth of that sample, which the weights have not seen, calibrates the scores.

Defined results: a null text, and one without a letter, is ``und`` with score 0; with no
training rows every text is ``und``; rows with equal texts get equal answers; of equal scores
the first language in order wins. The ``MOST_LANGUAGES`` labels with most training rows are
learnt, so that the model stays small however many strings stand in the column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id

DIM = 1 << 14
SAMPLE_ROWS, MOST_LANGUAGES = 3000, 200
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_SHIFT = np.uint32(32 - DIM.bit_length() + 1)
BLOCK = 1 << 16


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their logarithmic term frequencies."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(DIM, np.int64)
    for at in range(0, len(points), BLOCK):  # blocks overlap by two: every gram counts once
        p = points[at : at + BLOCK + 2]
        one = p * _A
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _B + p[1:]
        two *= _A
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _C + p[2:]
        three *= _A
        keys = np.concatenate([one[:BLOCK] >> _SHIFT, two[:BLOCK] >> _SHIFT, three[:BLOCK] >> _SHIFT])
        counts += np.bincount(keys, minlength=DIM)
    own = np.flatnonzero(counts)
    return own, np.log1p(counts[own]).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # feature, language
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, own: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[own]
        return x / max(float(np.sqrt((x * x).sum())), 1e-9)

    def logits(self, own: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return self.vector(own, tf) @ self.weights[own] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(*grams(text)).astype(np.float64) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def column(self, text: Column) -> Column:
        """A struct (lang, score) for each whole text."""
        model = self

        def run(col: pa.Array) -> pa.Array:
            got = [model.predict(x) for x in col.to_pylist()]
            return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang", "score"])

        return F.arrow_udf(run, "struct<lang:string, score:double>").asNondeterministic()(text)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], model: Model, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.001) -> None:
    """Train ``model`` on (features, term frequencies, class), in a fixed random order."""
    classes = len(model.languages)
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    order = np.random.default_rng(7)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    vectors = [(np.append(own, DIM), np.append(model.vector(own, tf), 1.0), y) for own, tf, y in rows]
    for _ in range(epochs):
        for i in order.permutation(len(vectors)).tolist():
            own, x, y = vectors[i]
            w = weights(z[own], n[own])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            square = n[own] + g * g
            z[own] += g - (np.sqrt(square) - np.sqrt(n[own])) / alpha * w
            n[own] = square
    w = weights(z, n)
    model.weights, model.bias = w[:DIM].astype(np.float32), w[DIM]


def calibrate(rows: list[tuple[np.ndarray, np.ndarray, int]], model: Model) -> None:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not rows:
        return
    logits = np.stack([model.logits(own, tf) for own, tf, _ in rows]).astype(np.float64)
    truth = np.array([y for *_, y in rows])

    def loss(t: float) -> float:
        return -float(np.log(softmax(logits / np.exp(t))[np.arange(len(truth)), truth] + 1e-12).mean())

    low, high, ratio = np.log(0.05), np.log(10), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    model.temperature = float(np.exp((low + high) / 2))


def _frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each feature, over all rows, and their number; each task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[grams(text)[0]] += 1
                df[DIM] += 1
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(df[own])], names=["feature", "n"])

    rows = train.select("text").mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    df = np.zeros(DIM + 1, np.int64)
    for r in rows.collect():  # at most DIM + 1 rows
        df[r["feature"]] = r["n"]
    return df[:DIM], int(df[DIM])


def _vectors(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [grams(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0].astype("<u2").tobytes() for g in got], pa.binary()), pa.array([g[1].astype("<f4").tobytes() for g in got], pa.binary())],
                names=["id", "lang", "own", "tf"],
            )

    return rows.select("id", "lang", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang string, own binary, tf binary")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the rows with text and language for which ``held_out`` is false."""
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.lit(False) if held_out is None else held_out).alias("held"))
    train = train.filter(~F.col("held") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = train.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES)
    sizes = {r["lang"]: r["count"] for r in sizes.collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(DIM, np.float32), np.zeros((DIM, 0), np.float32), np.zeros(0))
    df, total = _frequencies(train)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    each, share = max(1, sample_rows // len(languages)), F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / sizes[lang]))).otherwise(share)
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) < share * float(1 << 40)
    rows = _vectors(train.filter(drawn)).collect()  # about sample_rows
    rows.sort(key=lambda r: (str(r["id"]), bytes(r["own"]), bytes(r["tf"])))
    at = {x: i for i, x in enumerate(languages)}
    data = [(np.frombuffer(r["own"], "<u2").astype(np.int64), np.frombuffer(r["tf"], "<f4"), at[r["lang"]]) for r in rows]
    data = [data[i] for i in np.random.default_rng(11).permutation(len(data)).tolist()]
    model = Model(languages, idf, np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages)))
    cut = len(data) // 5
    ftrl(data[cut:] or data, model)
    calibrate(data[:cut], model)
    return model


def held_out_column(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 on division by 3."""
    return crc32_of_id(F.col(id_col)) % 3 == 1


def filter_documents(docs: DataFrame, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows whose language is found with at least ``min_score``, with the columns they came with."""
    model = fit(docs, text_col=text_col, held_out=held_out_column())
    name = "found"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, model.column(F.col(text_col)))
    return rows.filter((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.score") >= min_score)).drop(name)
