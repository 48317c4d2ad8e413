"""What the training-data operators share: shared storage, Arrow slicing, word spans.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D);
``bytes.split()`` and ``bytes.lower()`` follow the same rule on UTF-8 text.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..state import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 4 << 20


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: the folder's owner clears it
        pass


def materialise(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back, which cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/driftmap-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialised_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialise`` wrote for frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_materialised_at", None)
        if path:
            _forget(df.sparkSession, path)


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes in a string or binary column."""
    col = batch.column(column)
    if batch.num_rows == 0:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[col.offset : col.offset + batch.num_rows + 1]
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def as_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in (col if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else col.cast(kind)).to_pylist()]


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    schema: str,
    make: Callable[[], Callable[[list[bytes]], list[pa.Array]]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``id_col`` and, for slices of whole texts, the arrays of ``make()(texts)``.

    ``schema`` is DDL whose first column is the id. ``make`` runs once a task.
    """
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        names = None
        for batch in batches:
            for part in slices(batch, 1, limit):
                out = work(as_bytes(part.column(1)))
                names = names or [f"c{i}" for i in range(len(out) + 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *out], names=fields)

    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fieldNames()
    return narrow.mapInArrow(run, schema)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def crc32_of_id(col: Column) -> Column:
    """crc32 of an integer id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


# --- word spans and fingerprints over a whole slice ------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
        _INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
    return _POWERS[:n], _INVERSE[:n]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of all words of all texts, and where each text's words begin.

    The second array has one more entry than ``texts``.
    """
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends_at = np.cumsum(sizes + 1)
    if lower:
        buf = _LOWER[buf]
    inside = ~_SPACE[buf]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty(len(begins), np.uint64)
    block = 1 << 18  # bytes: the prefix sums stay in cache
    word = 0
    while word < len(begins):
        origin = begins[word]
        stop = max(int(np.searchsorted(ends, origin + block, side="right")), word + 1)
        b, e = begins[word:stop] - origin, ends[word:stop] - origin
        powers, inverse = _powers(int(e[-1]) + 1)
        sums = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(_TABLE[buf[origin : origin + int(e[-1])]] * powers[: int(e[-1])], out=sums[1:])
        out[word:stop] = mix64((sums[e] - sums[b]) * inverse[b] + (e - b).astype(np.uint64))
        word = stop
    bounds = np.concatenate([[0], np.searchsorted(begins, ends_at)])
    return out, bounds


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of the runs of ``size`` words; fewer words make one run; none make none."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out = mix64(out + np.uint64(0xD6E8FEB86659FD93)) + words[k : k + n]
    return mix64(out + np.uint64(size))
