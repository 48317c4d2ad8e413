"""Byte-level BPE, media columns, quality, language identification."""

import hashlib
import random
import struct

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from driftmap.llm import bpe, common, langid, media, quality

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def odd_rows():
    """Nulls anywhere, empty, blank and very long texts, repeated rows."""
    long = " ".join(f"word{i % 977} and the other" for i in range(20_000))
    texts = [None, "", "   \n\t ", "x", "é😀 Ünïcode’s", "a" * 3000, long, "same text here", "same text here", "<|endoftext|>", "123\n\n456   ñ"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, (None, "no id", None, None, None), (7, "same text here", "en", "s", 14)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def test_word_hashes_name_words():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\téA") for _ in range(rng.randint(0, 60))).encode() for _ in range(200)]
    hashes, bounds = common.word_hashes(texts)
    names = {}
    for t, a, b in zip(texts, bounds, bounds[1:], strict=False):
        words = t.lower().split()
        assert len(words) == b - a
        for w, h in zip(words, hashes[a:b].tolist(), strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_bpe_equals_tiktoken():
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(1)
    texts = [t or "" for _, t, *_ in odd_rows()]
    texts += ["".join(rng.choice("abcde th\n\té😀'sS19!") for _ in range(rng.randint(0, 200))) for _ in range(150)]
    texts += ["".join(rng.choice("theinraou") for _ in range(rng.randint(60, 200))) for _ in range(40)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_long_pieces(monkeypatch):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(7)
    pieces = [b"a" * n for n in (65, 66, 97, 1000, 1001)] + [b"ab" * 300, b"aab" * 200, b"\xc3\xa9" * 100]
    pieces += [bytes(rng.choice(b"etaoinsr") for _ in range(rng.randint(65, 3000))) for _ in range(30)]
    pieces += [bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(20_000))]
    want = [own.encode_ordinary(x.decode()) for x in pieces]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.merge(pieces)] == want and codec.closed
    monkeypatch.setattr(bpe, "BUCKETS", (64,))  # everything longer by the heap
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.merge(pieces)] == want
    monkeypatch.setattr(codec, "closed", False)  # one merge a round
    monkeypatch.setattr(bpe, "BUCKETS", (64, 1024))
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.merge(pieces)] == want
    assert all(codec.pairs.one(a, b) is None or codec.tokens[codec.pairs.one(a, b)] == codec.tokens[a] + codec.tokens[b] for a, b in zip(range(2000), range(500, 2500), strict=True))


def test_bpe_bytes_that_are_not_text(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe"))], "doc_id bigint, text binary")
    out = bpe.decode_column(bpe.encode_column(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).first()
    assert bytes(out["decoded"]).decode() == "ok \ufffd\ufffd"


def test_bpe_columns(spark, docs):
    out = bpe.decode_column(bpe.encode_column(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    texts = {(i, t or "") for i, t, *_ in odd_rows()}
    assert len(out) == docs.count() and {(r["doc_id"], bytes(r["decoded"]).decode()) for r in out} == texts
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in out)
    assert bpe.encode_column(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_media_round_trip():
    rng = random.Random(3)
    for n in [0, 1, 100, 157, 158, 159, 160, 161, 162, 163, 183, 184, 185, 345, 346, 347, 5000, 32_767, 32_768, 32_769, 70_000]:
        data = rng.randbytes(n)
        stream = media.mux(data)
        assert len(stream) % media.PACKET == 0
        got = media.demux(stream)
        assert got.payload == data and got.discontinuities == 0
        assert len(got.pts) == len(got.random_access) == -(-n // media.PES_PAYLOAD)
        assert got.programs == {1: media.PMT_PID} and got.pids == {media.MEDIA_PID: media.STREAM_TYPE}


def test_media_faults_show():
    stream = media.mux(bytes(5000))
    lost = stream[: 188 * 5] + stream[188 * 6 :]
    with pytest.raises(media.StreamError):
        media.demux(lost)
    swapped = bytearray(stream)
    swapped[188 * 6 + 3] ^= 3
    assert media.demux(bytes(swapped)).discontinuities == 2
    damaged = bytearray(stream)
    damaged[10] ^= 1
    with pytest.raises(media.StreamError):
        media.demux(bytes(damaged))
    assert media.crc_mpeg(b"123456789") == 0x0376E6E7


def packets(pid, data, start, counter, fill=True):
    """Packets of a table's sections, the first with a pointer."""
    out, first = b"", start
    while data or first:
        head = struct.pack(">BHB", media.SYNC, (0x4000 if first else 0) | pid, 0x10 | counter & 15) + (b"\0" if first else b"")
        room = media.PACKET - len(head)
        out += (head + data[:room]).ljust(media.PACKET, b"\xff")
        data, counter, first = data[room:], counter + 1, False
    return out


def section(table, number, body):
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", media.crc_mpeg(head))


def test_media_tables_over_several_packets():
    stream = media.mux(bytes(range(256)) * 30)
    many = b"".join(struct.pack(">HH", n, 0xE000 | 0x1000 + n) for n in range(2, 100)) + struct.pack(">HH", 1, 0xE000 | media.PMT_PID)
    pmt = struct.pack(">HH", 0xE000 | media.MEDIA_PID, 0xF000) + struct.pack(">BHH", media.STREAM_TYPE, 0xE000 | media.MEDIA_PID, 0xF000 | 200) + bytes(200)
    tables = packets(0, section(0, 1, many), True, 0) + packets(media.PMT_PID, section(2, 1, pmt), True, 0)
    assert len(tables) > 4 * media.PACKET
    got = media.demux(tables + stream[2 * media.PACKET :] + tables)
    assert got.payload == bytes(range(256)) * 30 and len(got.programs) == 99 and got.pids == {media.MEDIA_PID: media.STREAM_TYPE}
    with pytest.raises(media.StreamError):
        media.demux(tables[:200] + b"?" + tables[201:] + stream[2 * media.PACKET :])


def test_media_packets_sent_twice_and_announced_jumps():
    payload = random.Random(9).randbytes(80_000)
    stream = media.mux(payload)
    for k in (2, 5, 9):
        twice = stream[: 188 * (k + 1)] + stream[188 * k :]
        got = media.demux(twice)
        assert got.payload == payload and got.discontinuities == 0
    jumped = bytearray(stream)
    first = next(i for i in range(3, len(stream) // 188) if stream[i * 188 + 1] & 0x40)  # the second elementary packet
    for i in range(first, len(stream) // 188):
        jumped[i * 188 + 3] = jumped[i * 188 + 3] & 0xF0 | (jumped[i * 188 + 3] + 5) & 15
    assert media.demux(bytes(jumped)).discontinuities == 1
    jumped[first * 188 + 5] |= 0x80
    assert media.demux(bytes(jumped)).discontinuities == 0


def test_media_columns(docs):
    back = media.decode_column(media.encode_column(docs), ["doc_id", "n_bytes"]).collect()
    want = sorted(media.pad((t or "").encode()) for _, t, *_ in odd_rows())
    assert sorted(bytes(r["payload"]) for r in back) == want
    assert all(len(r["payload"]) % 64 == 0 and len(r["payload"]) > 0 for r in back)
    same = {(bytes(r["media"]), r["feature"]) for r in back if r["doc_id"] in (7, 8)}
    assert len(same) == 1
    assert media.encode_column(docs.limit(0)).count() == 0


def brute_counts(text):
    words = (text or "").encode().split()
    cover = [False] * len(words)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                cover[i : i + 8] = [True] * 8
    lines, dups = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dups += line in lines
            lines.add(line)
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), dups, sum(cover)


def test_quality_counts(docs):
    rng = random.Random(5)
    texts = [t for _, t, *_ in odd_rows()]
    texts += [" ".join(rng.choice("a b é ## c\nd") for _ in range(rng.randint(0, 80))) for _ in range(100)]
    rows = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["f"] for r in rows.select("doc_id", quality.features(F.col("text")).alias("f")).collect()}
    for i, t in enumerate(texts):
        f = got[i]
        assert (f["n_words"], f["word_chars"], f["n_symbols"], f["n_dup_lines"], f["n_repeat_words"]) == brute_counts(t), repr(t)[:80]


def test_quality_em_finds_the_two_classes():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.85
    votes = np.ones((20_000, len(quality.RULES)), int)
    for j in range(len(quality.RULES)):
        votes[(~good) & (rng.random(20_000) < 0.6), j] = 0
        votes[good & (rng.random(20_000) < 0.01), j] = 0
    model = quality.em(votes, np.ones(len(votes)), quality.RULES)
    assert abs(model.prior - 0.85) < 0.02
    odds = np.log(model.prior / (1 - model.prior)) + sum(model.weights[j][votes[:, j]] for j in range(votes.shape[1]))
    assert ((odds > 0) == good).mean() > 0.98


def test_quality_filter_edges(spark, docs):
    clashing = docs.withColumn("f", F.lit(1)).withColumn("n_words", F.lit("x"))
    kept = quality.filter_documents(clashing)
    assert kept.columns == clashing.columns
    kept.count()
    assert quality.filter_documents(docs.limit(0)).count() == 0


def languages(spark):
    rng = random.Random(4)
    letters = {"aa": "etaoin shrdlu", "bb": "xzqjkvb wyüöß", "cc": "абвгдежз икл"}
    rows, i = [], 0
    for lang, alphabet in letters.items():
        for _ in range(150):
            rows.append((i, "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 200))), lang, "s", 0))
            i += 1
    return spark.createDataFrame([*rows, (9001, None, "aa", None, None), (9002, " 12 !", None, None, None), (None, "no id e t", None, None, None)], SCHEMA)


def test_language_held_out_accuracy(spark):
    docs = languages(spark)
    held = langid.held_out_column()
    model = langid.fit(docs, held_out=held)
    assert model.languages == ["aa", "bb", "cc"]
    out = docs.select("doc_id", "lang", held.alias("held"), model.column(F.col("text")).alias("f")).collect()
    own = [r for r in out if r["held"] and r["doc_id"] is not None and r["doc_id"] < 9000]
    assert sum(r["f"]["lang"] == r["lang"] for r in own) >= 0.99 * len(own) and len(own) > 50
    by_id = {r["doc_id"]: r["f"] for r in out}
    assert by_id[9001]["lang"] == by_id[9002]["lang"] == "und" and by_id[9001]["score"] == 0
    assert all(0 <= r["f"]["score"] <= 1 for r in out)


def test_language_calibration_and_sparsity(spark):
    model = langid.fit(languages(spark))
    assert 0.05 <= model.temperature <= 10
    assert (model.weights == 0).mean() > 0.5  # the elastic net's first penalty


def test_language_equals_brute_force(spark):
    """The columns' answers from the model's weights, gram by gram, and document frequencies counted one by one."""
    docs = languages(spark)
    model = langid.fit(docs)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    learnt = [t for t, lang in rows if t is not None and lang is not None]
    df = np.zeros(langid.DIM)
    for t in learnt:
        df[langid.grams(t)[0]] += 1
    assert np.allclose(model.idf, np.log((1 + len(learnt)) / (1 + df)) + 1, atol=1e-5)
    got = [r["f"] for r in docs.select("text", model.column(F.col("text")).alias("f")).collect()]
    for (text, _), f in list(zip(rows, got, strict=True))[::40]:
        counts = {}
        for g in (text or "").lower():
            counts[g] = counts.get(g, 0) + 1
        own, tf = langid.grams(text or "")
        assert sum(round(float(np.expm1(x))) for x in tf) == sum(max(0, len(text or "") - k) for k in range(3))
        if f["lang"] == "und":
            continue
        x = {int(i): float(v) * float(model.idf[i]) for i, v in zip(own, tf, strict=True)}
        norm = sum(v * v for v in x.values()) ** 0.5
        logits = [sum(v / norm * float(model.weights[i, c]) for i, v in x.items()) + float(model.bias[c]) for c in range(3)]
        p = np.exp(np.array(logits) / model.temperature)
        assert f["lang"] == model.languages[int(p.argmax())] and abs(f["score"] - p.max() / p.sum()) < 1e-4


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rare = spark.createDataFrame([(20_000, "zzz", "rare", None, None)], SCHEMA)
    assert langid.fit(languages(spark).filter("lang <> 'cc'").unionByName(rare)).languages == ["aa", "bb"]


def test_language_edges(spark, docs):
    empty = langid.fit(docs.limit(0))
    assert empty.predict("text") == ("und", 0.0)
    clashing = docs.withColumn("found", F.lit(0))
    assert langid.filter_documents(clashing).columns == clashing.columns
    assert langid.filter_documents(docs.limit(0)).count() == 0


def test_grams_cover_long_texts_once(monkeypatch):
    text = "".join(chr(97 + i % 23) for i in range(1000))
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "BLOCK", 64)
    parts = langid.grams(text)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_little_endian_digest():
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    ids = np.frombuffer(codec.encode(["hello world"])[0], "<u4").tolist()
    assert hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).digest() == hashlib.sha256(codec.encode(["hello world"])[0]).digest()
