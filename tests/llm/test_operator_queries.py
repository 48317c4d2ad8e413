"""The registered queries themselves, against SQL, other implementations and brute force, at the smallest scale."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken

import corpus_pipeline
import public_tokenizers
from driftmap.llm import html, langid, media, packing, quality, queries
from test_corpus_operators import brute_components
from test_text_operators import RANKS, brute_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def by_id(rows, name="doc_id"):
    out = {r[name]: r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.SQL[name])
    rows = run(spark, name)
    columns = sorted(rel.columns)
    assert columns == sorted(rows[0].asDict())
    assert sorted(repr([r[c] for c in columns]) for r in rows) == sorted(repr([r[rel.columns.index(c)] for c in columns]) for r in rel.fetchall())


def test_op1(spark, texts):
    got = by_id(run(spark, "op1_byte_bpe"))
    assert set(got) == set(texts)
    import base64

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        ids = own.encode_ordinary(texts[i] or "")
        want = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((texts[i] or "").encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), *want)


def test_op2(spark, texts):
    for i, r in by_id(run(spark, "op2_media_column")).items():
        data = (texts[i] or "").encode()
        size = max(64, -(-len(data) // 64) * 64)
        payload = data.ljust(size, b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), size, zlib.crc32(payload[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_bytes"] % 188 == 0
        # an elementary packet by hand: sync bytes, one stream, counters one after the other
        stream = media.mux(payload)
        assert r["media_sha256"] == hashlib.sha256(stream).hexdigest() and r["media_bytes"] == len(stream)
        own = [stream[k : k + 188] for k in range(0, len(stream), 188)]
        assert all(x[0] == 0x47 for x in own)
        counters = [x[3] & 15 for x in own if (x[1] & 31) << 8 | x[2] == media.MEDIA_PID]
        assert counters == [k % 16 for k in range(len(counters))]
        pieces = -(-size // media.PES_PAYLOAD)
        assert list(r["pts"]) == [k * media.PTS_STEP for k in range(pieces)] and len(r["random_access"]) == pieces
        assert all(stream[k * 188 + 5] & 0x40 for k in r["random_access"])


def test_op4(spark, texts):
    got = by_id(run(spark, "op4_gated_lm"))
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, own in words.items() if not held[i] for w in [*own, b""])
    n, v = sum(c.values()), len(c)
    for i, r in got.items():
        base = sum(np.log10((c[w] + 1) / (n * 1 + v + 1)) for w in [*words[i], b""])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(words[i]) + 1, sum(c[w] > 0 for w in [*words[i], b""]), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    own = [r for i, r in got.items() if held[i]]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_op6(spark, texts):
    for i, r in by_id(run(spark, "op6_weak_supervision")).items():
        n, chars, symbols, dups, repeats = brute_counts(texts[i])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, repeats)
        assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_op7(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = by_id(run(spark, "op7_html_layout"), "page_id")
    assert set(got) == set(pages)
    for i, r in got.items():
        text = html.extract(pages[i] or "")
        assert (r["text"], r["n_chars"], r["n_lines"]) == (text, len(text), sum(x != "" for x in text.split("\n")))


def test_op8(spark, texts):
    check_packing(run(spark, "op8_best_fit_packing"), texts)


def check_packing(rows, texts):
    """Every piece once, bins without holes or overlaps, and each as small as its contents allow."""
    placed, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        placed[r["doc_id"]].append((r["start"], r["start"] + r["length"]))
        bins[r["bin"], r["capacity"]].append((r["offset"], r["offset"] + r["length"]))
    assert set(placed) == set(texts)
    for i, spans in placed.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == len((texts[i] or "").encode().split()) + 1
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for (_, capacity), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert capacity == min(c for c in packing.CAPACITIES if c >= spans[-1][1])


def test_op9(spark, texts):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = by_id(run(spark, "op9_language_id"))
    assert set(got) == set(texts)
    own = [i for i in got if got[i]["held_out"] and lang[i] is not None and langid.has_letter(texts[i] or "")]
    assert sum(got[i]["lang_pred"] == lang[i] for i in own) >= 0.95 * len(own)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not langid.has_letter(texts[i] or ""))


def votes_of(text):
    """The rules of the quality stage, written out for one text: -1, 0 or 1 each."""
    raw, words = (text or "").encode(), (text or "").encode().split()
    n, chars, symbols, dups, repeats = brute_counts(text)
    lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n"))
    upper, lower = (sum(a <= b <= z for b in raw) for a, z in ((65, 90), (97, 122)))
    short = sum(len(w) <= 3 and (w[:1].isalnum() or w[0] >= 0x80) for w in words)
    echoes = sum(a == b for a, b in zip(words, words[1:], strict=False))
    per = lambda x: x / max(n, 1)
    if not n:
        upper = lower = 0
    stops, bangs = (raw.count(b".") if n else 0), (raw.count(b"!") if n else 0)
    bad = [
        per(symbols) > 0.1, n >= 3 and upper > lower, per(bangs) > 0.2, per(repeats) > 0.3, dups >= 3 and dups / max(lines, 1) > 0.3,
        n >= 5 and (per(chars) > 10 or per(chars) < 2), n >= 20 and per(short) < 0.12, n >= 20 and per(echoes) > 0.1, n >= 20 and per(stops) < 0.02, n == 0,
    ]
    good = [False] * 6 + [n >= 5 and per(short) > 0.25, False, n >= 5 and 0.03 <= per(stops) <= 0.4, False]
    return [-1 if b else 1 if g else 0 for b, g in zip(bad, good, strict=True)]


def test_pipeline_equals_brute_force(spark, texts):
    """Every stage once more in one process, on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    votes = {i: np.array(votes_of(t)) + 1 for i, t in texts.items()}
    combos = Counter(tuple(v) for v in votes.values())
    model = quality.em(np.array(sorted(combos)), np.array([combos[k] for k in sorted(combos)], float), quality.RULES)
    odds = {i: np.log(model.prior / (1 - model.prior)) + sum(model.weights[j][v[j]] for j in range(len(v))) for i, v in votes.items()}
    kept = {i: t for i, t in texts.items() if odds[i] >= 0}
    ids = spark.createDataFrame([(i,) for i in kept], "doc_id bigint")
    finder = langid.fit(docs.join(ids, "doc_id", "left_semi").select(docs.columns), held_out=langid.held_out_column())
    found = {i: finder.predict(t) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if found[i][0] != "und" and found[i][1] >= 0.5}
    component = brute_components(sorted(kept.items()), 5)
    kept = {i: t for i, t in kept.items() if component[i][1] == i}
    check_packing(corpus_pipeline.run(spark, SF).collect(), kept)
    assert 0 < len(kept) < len(texts)
