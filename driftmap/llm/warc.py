"""WARC archives: one gzip member per record, sequential reading with digests checked.

``write_archives`` turns rows into archives of bounded size, held as rows
(archive name, bytes) so that Spark's commit protocol protects them;
``read_archives`` reads such rows, or files through ``spark.read.format("binaryFile")``. A
record that is damaged, or whose digest is wrong, ends the read (``on_error="raise"``) or is
reported as a row of type ``error``, and the read goes on at the next gzip member.

Defined results: a null payload counts as empty; a null id is written as ``null`` and
read as null; of rows with equal id and payload each is a response of its own; an
empty table gives no archives. Extra columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialise, slices

ARCHIVE_BYTES = 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "archive string, record_type string, record_id string, refers_to string, target_uri string, "
    "payload binary, payload_bytes bigint, payload_digest string, verified boolean, error string"
)


class WarcError(ValueError):
    """An archive that breaks the format or a digest that does not match."""


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str, block: bytes, extra: list[tuple[str, str]] = ()) -> bytes:
    """One WARC/1.1 record as one gzip member."""
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", uri)] if uri else []),
        *extra,
        ("WARC-Block-Digest", f"sha1:{digest32(block)}"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    raw = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def member(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """The gzip member at an offset, inflated a chunk at a time, and where it ends."""
    view, z, out = memoryview(data), zlib.decompressobj(31), []
    while not z.eof:
        if at >= len(view):
            raise WarcError("the archive ends inside a gzip member")
        piece = view[at : at + step]
        try:
            out.append(z.decompress(piece))
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        at += len(piece) - len(z.unused_data)
    return b"".join(out), at


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of an archive, in order."""
    at = 0
    while at < len(data):
        raw, at = member(data, at, step)
        yield raw


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block framed by Content-Length."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/") or end < 0:
        raise WarcError("not a WARC record")
    fields = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        raise WarcError("a record without type or length")
    size = int(fields["content-length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) != size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise WarcError("content length and record do not agree")
    return fields, block


def records(data: bytes, on_error: str = "raise") -> Iterator[dict]:
    """Records of one archive; :class:`WarcError`, or a row that says what is wrong, for a damaged one."""
    if on_error not in ("raise", "report"):
        raise ValueError(f"no such way with errors: {on_error}")
    at = 0
    while at < len(data):
        begun = at
        try:
            raw, at = member(data, at)
            yield _read(raw)
        except WarcError as e:
            if on_error == "raise":
                raise
            if at == begun:  # the member itself is broken: look for the next
                at = data.find(b"\x1f\x8b\x08", begun + 1)
                at = len(data) if at < 0 else at
            yield dict.fromkeys(("record_id", "refers_to", "target_uri", "payload", "payload_bytes", "payload_digest")) | {
                "record_type": "error", "verified": False, "error": f"offset {begun}: {e}"
            }


def _read(raw: bytes) -> dict:
    """One record, its digests checked."""
    bare = lambda x: x.strip("<>") if x else None
    fields, block = parse(raw)
    want = fields.get("warc-block-digest")
    if want and want != f"sha1:{digest32(block)}":
        raise WarcError(f"block digest of {fields.get('warc-record-id')}")
    kind, payload, length = fields["warc-type"], None, None
    if kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                length = int(value)
    said = fields.get("warc-payload-digest")
    said = said.removeprefix("sha1:") if said else None
    if kind == "response":
        if said and said != digest32(payload):
            raise WarcError(f"payload digest of {fields.get('warc-record-id')}")
        length = len(payload)
    return {
        "record_type": kind,
        "record_id": bare(fields.get("warc-record-id")),
        "refers_to": bare(fields.get("warc-refers-to")),
        "target_uri": fields.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": said,
        "verified": kind == "response" and said is not None,
        "error": None,
    }


def mark_revisits(df: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to``: of rows with equal payloads the largest id, null for that row itself.

    Payloads under ``min_bytes`` never refer. The largest id of each digest is found with
    partial aggregates over digests and ids alone, and only digests that occur twice are joined
    back: while these are few Spark broadcasts them and no payload moves, beyond that it is a
    join that Spark can split on hot digests.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    first = rows.groupBy("sha").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND keeper IS NOT NULL")
    joined = rows.join(first.select("sha", "keeper"), "sha", "left")
    other = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")) & (F.octet_length("payload") >= min_bytes)
    return joined.select("id", "url", "payload", F.when(other, F.col("keeper")).alias("refers_to"))


def write_archives(marked: DataFrame, archive_bytes: int = ARCHIVE_BYTES, prefix: str = "pages") -> DataFrame:
    """Archives (archive, content) of the rows (id, url, payload, refers_to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        info = record("warcinfo", f"urn:{prefix}:info", "", b"software: driftmap\r\nformat: WARC File Format 1.1\r\n")

        def close() -> pa.RecordBatch:
            name = f"{prefix}-{part:05d}-{number:05d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

        for whole in batches:
            for batch in slices(whole, 2):
                for key, url, data, refers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                    name = "null" if key is None else key
                    uri = " ".join((url or "").split())
                    extra = [("WARC-Payload-Digest", f"sha1:{digest32(data)}"), ("Content-Type", "application/http; msgtype=response")]
                    if refers is None:
                        row = record("response", f"urn:{prefix}:{name}", uri, http_head(len(data)) + data, extra)
                    else:
                        extra += [("WARC-Refers-To", f"<urn:{prefix}:{refers}>"), ("WARC-Profile", PROFILE)]
                        row = record("revisit", f"urn:{prefix}:{name}", uri, http_head(len(data)), extra)
                    if not held:
                        held, size = [info], len(info)
                    held.append(row)
                    size += len(row)
                    if size >= archive_bytes:
                        yield close()
                        held, size, number = [], 0, number + 1
        if held:
            yield close()

    rows = marked.select("id", "url", F.col("payload"), "refers_to")
    return rows.mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame, on_error: str = "raise") -> DataFrame:
    """Records of archives (archive, content), one row each, in the columns of ``RECORD_SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("archive", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
            ("target_uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()), ("error", pa.string()),
        ])
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                held, size = [], 0
                for row in records(data or b"", on_error):
                    held.append({"archive": name} | row)
                    size += len(row["payload"] or b"") + 200
                    if size > (4 << 20):
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("archive", "content").mapInArrow(run, RECORD_SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """Write the rows as archives in the shared folder and read all page records back."""
    archives = materialise(write_archives(mark_revisits(pages, id_col, payload_col)), "warc", "uncompressed")
    return read_archives(archives).filter(F.col("record_type") != "warcinfo")
