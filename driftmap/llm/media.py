"""Media columns: payloads as MPEG transport streams in a binary column.

``mux`` stores bytes losslessly as one program: a PAT and a PMT, then elementary
packets (PES) with presentation times, each split over 188-byte transport packets with
continuity counters; every elementary packet begins at a random-access point with a
clock reference. ``demux`` parses the tables, checks the counters, reassembles the
elementary packets and keeps their times and random-access points.

Tables may span packets and come again; a packet sent twice counts once; a counter that jumps
where the stream says so is no fault, any other jump is counted.

Defined results: a null or empty payload gives a stream that holds whatever padding the
caller asked for, or no elementary packet at all; equal payloads, repeated or not, give equal
streams and features; a stream that breaks the format raises :class:`StreamError`.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, map_texts, slices

PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, MEDIA_PID = 0x0000, 0x0100, 0x0101
PROGRAM, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD  # private data
PES_PAYLOAD = 32_768
PTS_STEP = 3_600  # 40 ms of the 90 kHz clock
PAD = 64


class StreamError(ValueError):
    """A stream that breaks the format."""


def pad(data: bytes, multiple: int = PAD) -> bytes:
    """Zero bytes appended, up to a positive multiple."""
    return data + bytes(max(multiple, -(-len(data) // multiple) * multiple) - len(data))


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section_packet(pid: int, table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0)
    section = head + body
    section += struct.pack(">I", crc_mpeg(section))
    packet = struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section
    return packet + b"\xff" * (PACKET - len(packet))


_TABLES = _section_packet(PAT_PID, 0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID)) + _section_packet(
    PMT_PID, 0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | MEDIA_PID, 0xF000, STREAM_TYPE, 0xE000 | MEDIA_PID, 0xF000)
)


def _stamp(tag: int, pts: int) -> bytes:
    return bytes([tag << 4 | (pts >> 29) & 0x0E | 1, (pts >> 22) & 0xFF, (pts >> 14) & 0xFE | 1, (pts >> 7) & 0xFF, (pts << 1) & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """The transport stream of one payload."""
    out, counter = [_TABLES], 0
    for k, at in enumerate(range(0, len(payload), PES_PAYLOAD)):
        part, pts = payload[at : at + PES_PAYLOAD], (k * PTS_STEP) & 0x1FFFFFFFF
        pes = struct.pack(">IHBBB", 0x100 | STREAM_ID, len(part) + 8, 0x84, 0x80, 5) + _stamp(2, pts) + part
        clock = struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        first = b"\x07\x50" + clock  # length, random access and clock flags
        room = PACKET - 4 - len(first)
        if len(pes) < room:
            first = bytes([7 + room - len(pes)]) + first[1:] + b"\xff" * (room - len(pes))
            room = len(pes)
        out.append(struct.pack(">BHB", SYNC, 0x4000 | MEDIA_PID, 0x30 | counter) + first + pes[:room])
        counter = (counter + 1) & 15
        rest = len(pes) - room
        full, tail = divmod(rest, PACKET - 4)
        if full:
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
            block[:, 3] = 0x10 | ((counter + np.arange(full)) & 15)
            block[:, 4:] = np.frombuffer(pes, np.uint8, full * (PACKET - 4), room).reshape(full, PACKET - 4)
            out.append(block.tobytes())
            counter = (counter + full) & 15
        if tail:
            fill = PACKET - 4 - tail  # one byte of length, then flags and stuffing
            field_ = b"\x00" if fill == 1 else bytes([fill - 1, 0]) + b"\xff" * (fill - 2)
            out.append(struct.pack(">BHB", SYNC, MEDIA_PID, 0x30 | counter) + field_ + pes[len(pes) - tail :])
            counter = (counter + 1) & 15
    return b"".join(out)


@dataclass
class Stream:
    """What ``demux`` finds in one stream."""

    payload: bytes = b""
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    pids: dict[int, int] = field(default_factory=dict)  # elementary stream: type
    discontinuities: int = 0
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # packet numbers


def _section(data: bytes, table: int) -> bytes:
    size = struct.unpack_from(">H", data, 1)[0] & 0xFFF
    section = data[: size + 3]
    if len(section) < size + 3 or size < 9 or section[0] != table or crc_mpeg(section):
        raise StreamError("a table is damaged")
    return section[8:-4]


def _tables(pid: np.ndarray, starts: np.ndarray, kind: np.ndarray, cut, wanted: int):
    """The distinct sections of a table's packets, put together where they span several."""
    held, seen = b"", set()

    def whole(held: bytes):
        while len(held) >= 3 and held[0] != 0xFF:  # 0xFF: stuffing up to the packet's end
            size = (held[1] << 8 | held[2]) & 0xFFF
            if len(held) < size + 3:
                break
            yield held[: size + 3]
            held = held[size + 3 :]

    for i in np.flatnonzero((pid == wanted) & (kind & 1 == 1)).tolist():
        raw = cut(i)
        if starts[i] and raw:
            held += raw[1 : 1 + raw[0]]  # the end of a section that began before
            found = [*whole(held)]
            held = raw[1 + raw[0] :]
        else:
            held, found = held + raw if held else b"", []
        for section in [*found, *whole(held)]:
            if section not in seen:
                seen.add(section)
                yield section


def demux(data: bytes) -> Stream:
    """Parse one stream; raises :class:`StreamError` where it breaks the format."""
    if len(data) % PACKET:
        raise StreamError("the length is not a number of packets")
    got = Stream(packets=len(data) // PACKET)
    if not data:
        return got
    p = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise StreamError("a sync byte is missing")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    starts = (p[:, 1] & 0x40) != 0
    kind = p[:, 3] >> 4 & 3
    skip = np.where(kind & 2, p[:, 4].astype(np.int32) + 1, 0)
    skip = np.minimum(skip, PACKET - 4)
    cut = lambda i: data[i * PACKET + 4 + int(skip[i]) : (i + 1) * PACKET]
    for section in _tables(pid, starts, kind, cut, PAT_PID):
        body = _section(section, 0x00)
        for at in range(0, len(body) - 3, 4):
            number, to = struct.unpack_from(">HH", body, at)
            got.programs[number] = to & 0x1FFF
    for table in {to: None for number, to in got.programs.items() if number}:  # program 0 is the network's
        for section in _tables(pid, starts, kind, cut, table):
            body = _section(section, 0x02)
            at = 4 + (struct.unpack_from(">H", body, 2)[0] & 0xFFF)
            while at + 5 <= len(body):
                sort, to, info = struct.unpack_from(">BHH", body, at)
                got.pids[to & 0x1FFF] = sort
                at += 5 + (info & 0xFFF)
    parts = []
    for stream in got.pids:
        own = np.flatnonzero((pid == stream) & (kind & 1 == 1))
        if not len(own):
            continue
        counters = p[own, 3] & 15
        again = np.zeros(len(own), bool)  # the packet before, sent again
        for k in (np.flatnonzero(counters[1:] == counters[:-1]) + 1).tolist():
            again[k] = starts[own[k]] == starts[own[k - 1]] and cut(int(own[k])) == cut(int(own[k - 1]))
        own, counters = own[~again], counters[~again]
        extra = (kind[own] & 2 != 0) & (p[own, 4] > 0)
        allowed = extra & (p[own, 5] & 0x80 != 0)
        got.discontinuities += int((((counters[1:] - counters[:-1]) & 15 != 1) & ~allowed[1:]).sum())
        flagged = extra & (p[own, 5] & 0x40 != 0)
        got.random_access += own[flagged].tolist()
        first = np.flatnonzero(starts[own])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
            piece = []
            run = own[a:b]
            plain = kind[run] == 1
            plain[[0, -1]] = False
            piece.append(data[int(run[0]) * PACKET + 4 + int(skip[run[0]]) : (int(run[0]) + 1) * PACKET])
            if plain[1:-1].all() and len(run) > 2:
                piece.append(p[run[1:-1], 4:].tobytes())
            else:
                piece += [data[i * PACKET + 4 + int(skip[i]) : (i + 1) * PACKET] for i in run[1:-1].tolist()]
            if len(run) > 1:
                piece.append(data[int(run[-1]) * PACKET + 4 + int(skip[run[-1]]) : (int(run[-1]) + 1) * PACKET])
            pes = b"".join(piece)
            if pes[:3] != b"\0\0\1":
                raise StreamError("an elementary packet has no start code")
            size, flags, more = struct.unpack_from(">HxBB", pes, 4)
            if size and size != len(pes) - 6:
                raise StreamError("an elementary packet is cut short")
            if flags & 0x80:
                t = pes[9:14]
                got.pts.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
            parts.append(pes[9 + more :])
    got.payload = b"".join(parts)
    return got


def feature(s: Stream) -> str:
    """A short account of a stream: counts, times and the payload's mean and deviation."""
    x = np.frombuffer(s.payload, np.uint8)
    mean, dev = (round(float(x.mean()), 3), round(float(x.std()), 3)) if len(x) else (0.0, 0.0)
    span = f"{s.pts[0]}-{s.pts[-1]}" if s.pts else "-"
    return f"ts:{s.packets} pes:{len(s.pts)} pts:{span} rap:{len(s.random_access)} cc:{s.discontinuities} mean:{mean:.3f} dev:{dev:.3f}"


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each whole text, padded, as a transport stream."""

    def make():
        return lambda texts: [pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(pad(x)) for x in texts], pa.binary())]

    return map_texts(df, id_col, text_col, f"{id_col} {df.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary", make)


def decode_column(media: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns ``keep``, the stream itself and what ``demux`` reads back from it.

    Adds payload, pts, random_access and feature; a discontinuity shows in ``feature``.
    """
    narrow = media.select(*keep, media_col)
    at = len(keep)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, at):
                got = [demux(x) for x in as_bytes(batch.column(at))]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([g.payload for g in got], pa.binary()), pa.array([g.pts for g in got], pa.list_(pa.int64())), pa.array([g.random_access for g in got], pa.list_(pa.int64())), pa.array([feature(g) for g in got])],
                    names=[*batch.schema.names, "payload", "pts", "random_access", "feature"],
                )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema)
    return narrow.mapInArrow(run, f"{kept}, payload binary, pts array<bigint>, random_access array<bigint>, feature string")
