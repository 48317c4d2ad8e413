"""Near-duplicates, packing, the language model, WARC, URL filters, HTML."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmap.llm import html, lm, minhash, packing, urlfilter, warc
from test_text_operators import SCHEMA, odd_rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def brute_components(rows, size, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def copies(seed=1, groups=12, most=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 8))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rows += [rows[0], rows[0].upper(), None, "", "one", "ONE", "two words"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rows = copies(size)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, size=size).collect()}
    assert got == brute_components(rows, size)


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK_OUTSIDE", 5)
    monkeypatch.setattr(minhash, "BLOCK_ALL", 9)
    rows = copies(9, groups=3, most=60)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, size=2).collect()}
    assert got == brute_components(rows, 2)


def test_near_duplicates_with_repeated_ids(spark, monkeypatch):
    """Two ids of 1,000 rows each are two nodes, not a million pairs."""
    seen = []
    verify = minhash.verify

    def watched(pairs, sets, percent):
        left, right = (sets.select(F.col("id").alias(x)) for x in ("a", "b"))
        seen.append(pairs.join(left, "a").join(right, "b").count())
        return verify(pairs, sets, percent)

    monkeypatch.setattr(minhash, "verify", watched)
    words = [f"w{i}" for i in range(40)]
    texts = {7: " ".join(words), 9: " ".join([*words[:39], "other"])}
    rows = [(i, texts[i]) for i in (7, 9) for _ in range(1000)] + [(9, texts[9].upper()), (11, "alone it stands"), (11, " ".join(words[:39]))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size=2).collect()
    assert len(out) == len(rows) and 0 < sum(seen) < 10
    assert {r["component_id"] for r in out if r["doc_id"] in (7, 9)} == {7}
    assert len({r["component_id"] for r in out if r["doc_id"] == 11}) == 1


def test_first_permutation_is_one():
    c = minhash.circulant()
    assert sorted(c.first.tolist()) == list(range(minhash.CIRCLE))


def test_near_duplicates_edges(spark, docs):
    out = minhash.near_duplicates(docs, size=2).collect()
    assert len(out) == docs.count()
    null = [r for r in out if r["doc_id"] is None]
    assert len(null) == 1 and null[0]["component_id"] is None
    assert {r["component_id"] for r in out if r["doc_id"] in (7, 8)} == {7}
    assert all(r["kept"] for r in out if r["n_shingles"] == 0)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    clashing = docs.withColumn("id", F.lit(1)).withColumn("component", F.lit(2)).withColumn("dropped", F.lit(3))
    kept = minhash.filter_documents(clashing)
    assert kept.columns == clashing.columns and 8 not in [r["doc_id"] for r in kept.collect()]
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, percent=70)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    sets = [np.unique(np.concatenate([shared, x])) for x in (a, b)]
    s = minhash.circulant(512).signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.08


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}
    for _ in range(len(up)):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: c for x, c in up.items() if x != c}


def naive_pack(lengths, sizes):
    rate, left = min(packing.cost(c) / c for c in sizes), sum(lengths)
    used, limit, places = [], [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        left -= n
        fits = [(limit[b] - used[b], b) for b in range(len(used)) if limit[b] - used[b] >= n]
        if fits:
            b = min(fits)[1]
        else:
            b = len(used)
            used.append(0)
            limit.append(min((packing.cost(c) - rate * min(c - n, left), c) for c in sizes if c >= n)[1])
        places[i] = (b, used[b])
        used[b] += n
    return places, [min(c for c in sizes if c >= u) for u in used]


def test_packing_equals_naive():
    rng = random.Random(1)
    for _ in range(150):
        lengths = [min(4096, int(rng.expovariate(1 / 400)) + 1) for _ in range(rng.randint(0, 100))]
        assert packing.pack(lengths) == naive_pack(lengths, packing.CAPACITIES)


def test_packing_spreads_repeated_rows_and_long_documents(spark):
    rows = [(1, "same words here")] * 5000 + [(2, "w " * (4096 * 300))] + [(3, None), (None, "x")]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), shard_items=256)
    shards = [r["n"] for r in out.groupBy((F.col("bin") / 2**32).cast("long").alias("shard")).agg(F.count("*").alias("n")).collect()]
    assert sum(shards) == 5000 + 301 + 2 and max(shards) < 2 * 256 and len(shards) == 21
    assert out.filter("doc_id = 2").select((F.col("bin") / 2**32).cast("long")).distinct().count() == 21
    assert out.agg(F.sum("length")).first()[0] == 5000 * 4 + 4096 * 300 + 1 + 1 + 2


def test_packing_places_every_token_once(spark, docs):
    out = packing.pack_documents(docs, shard_items=4).collect()
    need = Counter()
    for i, t, *_ in odd_rows():
        need[i] += len((t or "").encode().split()) + 1
    placed = Counter()
    bins = {}
    for r in out:
        placed[r["doc_id"]] += r["length"]
        bins.setdefault((r["bin"], r["capacity"]), []).append((r["offset"], r["offset"] + r["length"]))
    assert placed == need
    for (_, capacity), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert not any(c < capacity and spans[-1][1] <= c for c in packing.CAPACITIES)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_lm_gradients():
    v = lm.Vocabulary([b"", *[b"w%d" % i for i in range(9)]], np.array([50, 40, 30, 20, 10, 5, 4, 3, 2, 1]), 200, 12, 8)
    net = lm.Network.of(v)
    assert len(net.edges) >= 3
    net = lm.Network(8, 5, edges=net.edges)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    rng = np.random.default_rng(0)
    ids = [np.append(rng.integers(0, 9, n), 0).astype(np.int32) for n in (5, 9, 3, 7)]
    x, y, valid, fresh, _ = next(iter(lm.windows(ids, 0, 2, 64)))
    start = np.zeros((x.shape[1], 5))
    assert fresh.sum() == 4 and not fresh.all(0).any()

    def loss():
        states, _, _ = net.forward(x, fresh, start)
        return -net.log_probs(states[valid].astype(np.float64), y[valid]).sum() / valid.sum()

    grads, _, _ = net.gradients(x, y, valid, fresh, start)
    own, rows = grads["embed"]
    grads["embed"] = np.zeros_like(net.p["embed"])
    grads["embed"][own] = rows
    for k in net.p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in net.p[k].shape)
            old = net.p[k][at]
            net.p[k][at] = old + 1e-3
            up = loss()
            net.p[k][at] = old - 1e-3
            down = loss()
            net.p[k][at] = old
            assert abs((up - down) / 2e-3 - grads[k][at]) < 1e-5


def plain_lm(net, ids, end):
    """Log-probability of a document, one token and one formula after the other."""
    p, n = {k: x.astype(np.float64) for k, x in net.p.items()}, net.hidden
    h, before, total = np.zeros(n), end, 0.0
    for y in ids:
        a, u = p["embed"][before] @ p["wx"] + p["b"], h @ p["wh"]
        r, z = (1 / (1 + np.exp(-a[k : k + n] - u[k : k + n])) for k in (0, n))
        new = np.tanh(a[2 * n :] + r * u[2 * n :])
        h = new + z * (h - new)
        c, before = int(net.class_of[y]), y
        first = net.edges[c]
        last = net.edges[c + 1] if c + 1 < net.classes else first + 1
        for w, at in ((p["wc"], c), (p["wo"][first:last], y - first)):
            logits = w[:, :n] @ h + w[:, n]
            total += logits[at] - logits.max() - np.log(np.exp(logits - logits.max()).sum())
    return total


@pytest.mark.parametrize("scale", [1, 40])  # logits that need no shift, and large ones
def test_lm_scores_equal_plain_formulas(scale):
    rng = np.random.default_rng(5)
    net = lm.Network(3000, 6, edges=np.array([0, 1, 4, 30, 800, 3000]))
    net.p = {k: (x + rng.standard_normal(x.shape) * 0.3).astype(np.float32) * np.float32(scale if k in ("wc", "wo") else 1) for k, x in net.p.items()}
    net.check()
    assert net.safe == (scale == 1)
    ids = [np.append(np.minimum(rng.zipf(1.2, k) - 1, 3000), 0).astype(np.int32) for k in (3, 0, 700, 2500)]
    want = [plain_lm(net, x.tolist(), 0) for x in ids]
    assert np.allclose(lm.score(net, ids, 0), want, rtol=2e-4)
    assert np.allclose(lm.score(net, ids, 0, net.inputs()), want, rtol=2e-4)


def test_lm_training_works_in_the_memory_it_has():
    import pickle
    import tracemalloc

    net, rng = lm.Network(2000, 20), np.random.default_rng(7)
    ids = [rng.integers(0, 2001, 60).astype(np.int32) for _ in range(1024)]
    parts = list(lm.windows(ids, 0, 1024, 16))
    h = np.zeros((1024, 20), np.float32)
    net.gradients(*parts[0][:4], h)
    tracemalloc.start()
    net.gradients(*parts[1][:4], h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # arrays made anew for every window took twice that, and a fault for every page
    assert len(pickle.dumps(net)) < 2 * sum(x.nbytes for x in net.p.values())


def test_lm_windows_carry_state():
    net = lm.Network(8, 4, 3)
    rng = np.random.default_rng(1)
    ids = [np.append(rng.integers(0, 9, n), 0).astype(np.int32) for n in (50, 3, 70, 1, 0)]
    together = lm.score(net, ids, 0)
    alone = [float(lm.score(net, [x], 0)[0]) for x in ids]
    assert np.allclose(together, alone, atol=1e-4)


def test_lm_is_a_distribution():
    net = lm.Network(8, 4, 3)
    h = np.random.default_rng(2).standard_normal((1, 4)).astype(np.float32)
    total = sum(math.exp(float(net.log_probs(h, np.array([w]))[0])) for w in range(9))
    assert abs(total - 1) < 1e-5


def test_lm_scores_equal_brute_base(spark, docs):
    rng = random.Random(6)
    words = [[f"{kind}{int(rng.paretovariate(1))}" for _ in range(300)] for kind in "ab"]  # a document keeps to one kind
    more = [(100 + i, " ".join(rng.choice(words[i % 2]) for _ in range(rng.randint(0, 80))), None, None, None) for i in range(400)]
    df = docs.filter("doc_id <> 6 OR doc_id IS NULL").unionByName(docs.sparkSession.createDataFrame(more, SCHEMA))
    out = lm.score_documents(df, lm.held_out_column, head=40, model_words=16).collect()
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in df.collect()]
    import zlib

    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter()
    for i, w in rows:
        if not held(i):
            c.update(w)
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(w) + 1, sum(x in c for x in w) + 1, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, b""]), 6)) for i, w in rows)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs(g[4] - w[4]) < 1e-5 for g, w in zip(got, want, strict=True))
    assert {r["train_tokens"] for r in out} == {n} and all(r["score"] < 0 for r in out)
    own = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] >= 100]
    assert sum(r["score"] for r in own) > sum(r["base_score"] for r in own)


def test_lm_trains_on_every_token(spark):
    texts = ["", "one", *[" ".join(f"w{(i * j) % 90}" for j in range(400)) for i in range(9)]]
    docs = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, key bigint")
    v = lm.vocabulary(lm.count_tokens(docs))
    net = lm.learn(docs, v, spark.sparkContext.broadcast(v))
    assert net.seen == v.tokens == 1 + 9 * 400 + len(texts)


def test_lm_models_more_words_of_larger_texts(spark):
    known = []
    for many in (1000, 9000):
        docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(j, many, 3)),) for j in range(3)] * 2, "text string")
        v = lm.vocabulary(lm.count_tokens(docs), head=50)
        net = lm.Network.of(v)
        assert v.tail_tokens <= (1 - lm.MODEL_TOKENS) * v.tokens and len(v.words) >= v.known
        assert net.edges[-1] == v.known and len(net.class_of) == v.known + 1
        assert 0.6 < net.classes / v.known**0.5 < 1.6 and net.classes + np.diff(net.edges).mean() < 2.3 * v.known**0.5
        known.append(v.known)
    assert known == [1001, 9001]


def test_lm_classes_are_cheap_for_skewed_counts():
    counts = np.sort(np.random.default_rng(4).zipf(1.2, 5000).clip(max=10**6))[::-1]
    edges, share = lm.class_edges(counts, counts.sum()), counts / counts.sum()
    price = lambda e: len(e) - 1 + sum((b - a) * share[a:b].sum() for a, b in zip(e[:-1], e[1:], strict=True))
    assert edges[0] == 0 and edges[-1] == 5000 and (np.diff(edges) > 0).all()
    assert price(edges) < 0.7 * price([*range(0, 5000, 71), 5000])


def test_lm_index_belongs_to_its_vocabulary():
    class Shared:
        def __init__(self, value):
            self.value = value

    for i in range(300):  # each vocabulary is freed before the next comes, perhaps to the same address
        v, index = lm._Indexed.of(Shared(lm.Vocabulary([b"", b"w%d" % i], np.array([2, 1]), 3, 2, 2)))
        assert index == {b"": 0, b"w%d" % i: 1} and v.words[1] == b"w%d" % i


def test_lm_long_texts_beside_short_ones_stay_small():
    import tracemalloc

    net, rng = lm.Network(8, 4, 3), np.random.default_rng(3)
    ids = [np.append(rng.integers(0, 9, n), 0).astype(np.int32) for n in (60_000, *[20] * 1000)]
    tracemalloc.start()
    together = lm.score(net, ids, 0, net.inputs())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # dense lanes would take 60,000 x 512 places of each array
    assert np.allclose(together[:3], [float(lm.score(net, [x], 0)[0]) for x in ids[:3]], rtol=1e-4)


def test_lm_words_too_long_to_travel_are_joined(spark):
    long = "x" * (lm.HEAD_BYTES + 1)
    docs = spark.createDataFrame([(i, f"{long} a {long}") for i in range(6)], "doc_id bigint, text string")
    v = lm.vocabulary(lm.count_tokens(docs))
    assert sorted(v.words) == [b"", b"a"] and v.distinct == 3
    out = lm.score_documents(docs, lambda c: F.lit(False)).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out} == {(4, 4, 24)}
    want = math.log10(13 / 28) * 2 + math.log10(7 / 28) * 2
    assert all(abs(r["base_score"] - want) < 1e-9 for r in out)


def test_lm_empty_table(spark, docs):
    assert lm.score_documents(docs.limit(0), lm.held_out_column).count() == 0


PAGES = [(1, "http://a", "<p>x"), (2, "http://b", "<p>x"), (9, "http://c", "<p>x"), (3, None, None), (4, "u", ""), (5, "u", "ü" * 40_000), (None, "n", "<p>x"), (5, "u", "ü" * 40_000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    out = warc.round_trip(pages).collect()
    got = sorted((r["record_id"].split(":")[-1], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in out)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        same = [j for j, _, x in PAGES if (x or "") == (h or "") and j is not None]
        to = max(same) if i != max(same) else None
        want.append((str(i).replace("None", "null"), "response" if to is None else "revisit", len(data), warc.digest32(data), to and f"urn:pages:{to}"))
    assert got == sorted(want, key=lambda x: x[:4])
    assert all(bytes(r["payload"]).decode() in [(h or "") for _, _, h in PAGES] for r in out if r["record_type"] == "response")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_checks():
    one = warc.record("response", "urn:x:1", "http://x", warc.http_head(3) + b"abc", [("WARC-Payload-Digest", "sha1:" + warc.digest32(b"abc"))])
    assert [r["payload"] for r in warc.records(one + one)] == [b"abc", b"abc"]
    assert b"".join(warc.members(one, step=7))[:5] == b"WARC/"
    with pytest.raises(warc.WarcError):
        list(warc.records(one[:-9]))
    wrong = warc.record("response", "urn:x:1", "", warc.http_head(3) + b"abc", [("WARC-Payload-Digest", "sha1:" + warc.digest32(b"abd"))])
    with pytest.raises(warc.WarcError):
        list(warc.records(wrong))


def test_warc_damage_is_reported(spark):
    good = [warc.record("response", f"urn:x:{i}", "", warc.http_head(3) + b"abc", [("WARC-Payload-Digest", "sha1:" + warc.digest32(b"abc"))]) for i in range(4)]
    wrong = warc.record("response", "urn:x:9", "", warc.http_head(3) + b"abc", [("WARC-Payload-Digest", "sha1:" + warc.digest32(b"abd"))])
    broken = good[1][:30] + b"\0\0\0\0" + good[1][34:]
    data = good[0] + broken + good[2] + wrong + good[3][:-9]
    archives = spark.createDataFrame([("a", data), ("b", good[0]), ("c", None), ("d", b"junk")], "archive string, content binary").withColumn("payload", F.lit(1))
    rows = warc.read_archives(archives, "report").collect()
    assert [r["record_id"] for r in rows if r["record_type"] == "response"] == ["urn:x:0", "urn:x:2", "urn:x:0"]
    errors = [(r["archive"], r["error"], r["verified"]) for r in rows if r["record_type"] == "error"]
    assert len(errors) == 4 and not any(e[2] for e in errors) and all(e[1].startswith("offset ") for e in errors)
    with pytest.raises(Exception, match="WarcError"):
        warc.read_archives(archives).collect()


def test_warc_payloads_that_stand_alone_do_not_move(spark):
    pages = spark.createDataFrame([(i, "u", f"<p>{i // 2 if i < 4 else i}") for i in range(40)], "page_id bigint, url string, html string")
    marked = warc.mark_revisits(pages, "page_id", "html")
    assert {r["id"]: r["refers_to"] for r in marked.collect() if r["refers_to"] is not None} == {0: 1, 2: 3}
    assert "BroadcastHashJoin" in marked._jdf.queryExecution().executedPlan().toString() or spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_url_filter_addresses_and_clashing_names(spark):
    changes = spark.createDataFrame([("l", "[2001:db8::1]", "add", "2023-01-01"), ("l", "example.com", "add", "2023-01-01")], "list_name string, entry string, action string, day string").withColumn("day", F.col("day").cast("date"))
    asked = [("http://[2001:DB8::1]:80/x", "[2001:db8::1]", True), ("http://[fe80::1]/", "[fe80::1]", False), ("http://u@a.example.com", "a.example.com", True)]
    captures = spark.createDataFrame([(u, "2023-05-01", "old", 7, i) for i, (u, *_) in enumerate(asked)], "url string, day string, host string, entry int, asked_day int").withColumn("day", F.col("day").cast("date"))
    out = urlfilter.judge(captures, changes)
    assert out.columns == ["url", "day", "asked_day", "host", "listed", "n_entries", "entry", "lists"]
    assert {(r["asked_day"], r["host"], r["listed"]) for r in out.collect()} == {(i, h, x) for i, (_, h, x) in enumerate(asked)}


def test_url_filter(spark):
    changes = spark.createDataFrame(
        [("l", "example.com", "add", "2023-01-10"), ("l", "example.com", "remove", "2023-02-01"), ("l", "example.com", "add", "2023-03-01"), ("m", "bad.example.com", "add", "2023-01-20"), ("m", "bad.example.com", "add", "2023-01-25"), ("l", "10.0.0.1", "add", "2023-01-01"), ("l", "x.org", "add", "2023-01-05"), ("l", "x.org", "remove", "2023-01-05"), ("l", None, "add", None)],
        "list_name string, entry string, action string, day string",
    ).withColumn("day", F.col("day").cast("date"))
    asked = [
        ("http://a.example.com/x", "2023-01-10", "example.com", "l"), ("http://EXAMPLE.com:80", "2023-01-31", "example.com", "l"), ("http://example.com.", "2023-02-01", None, ""),
        ("https://u:p@bad.example.com?q", "2023-02-05", "bad.example.com", "m"), ("http://bad.example.com", "2023-03-02", "bad.example.com", "l,m"), ("http://notexample.com", "2023-03-02", None, ""),
        ("http://10.0.0.1/", "2023-05-01", "10.0.0.1", "l"), ("http://0.0.1/", "2023-05-01", None, ""), ("/relative", "2023-03-02", None, ""), (None, "2023-03-02", None, ""), ("http://example.com", None, None, ""), ("http://x.org", "2023-01-06", None, ""),
        ("http://a.example.com/x", "2023-01-10", "example.com", "l"),
    ]
    captures = spark.createDataFrame([(u, d, i) for i, (u, d, *_) in enumerate(asked)], "url string, day string, salt int").withColumn("day", F.col("day").cast("date"))
    out = urlfilter.judge(captures, changes).collect()
    assert len(out) == len(asked)
    for r in out:
        _, _, entry, lists = asked[r["salt"]]
        assert (r["entry"], ",".join(r["lists"]), r["listed"]) == (entry, lists, entry is not None)
    assert urlfilter.judge(captures.limit(0), changes).count() == 0
    assert urlfilter.judge(captures, changes.limit(0)).filter("listed").count() == 0


def test_url_filter_is_native(spark):
    captures = spark.createDataFrame([("http://a", None)], "url string, day date")
    changes = spark.createDataFrame([], "list_name string, entry string, action string, day date")
    plan = urlfilter.judge(captures, changes)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b", "a\n\nb"),
        ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
        ("<title>t</title><script>var x='</p>';</script><style>p{}</style><p>v</p><noscript>n</noscript>", "v"),
        ("<div style='display: none'>x<p>y</div><p hidden>z</p>ok", "ok"),
        ("<span style='visibility:hidden'>n<b style='visibility:visible'>yes</b></span>", "yes"),
        ("<ul><li>a<li>b<ol start=3><li>q<li>r</ol></ul>", "- a\n- b\n  3. q\n  4. r"),
        ("<table><tr><th>a<th>bbb<tr><td>longer<td>x<tr><td>1</table>", "a       bbb\nlonger  x\n1"),
        ("<table><caption>c</caption><tbody><tr><td>1<td><table><tr><td>in<td>ner</table></table>", "c\n1  in ner"),
        ("<pre>a  b\n  c</pre>", "a  b\n  c"),
        ("a &amp; &lt;b&gt; &eacute; <!-- c --> d", "a & <b> é d"),
        ("x <!-- open", "x"),
        ("1 < 2 <3 <a href='q>open", "1 < 2 <3 open"),
        ("<b><p>x</b>y</p>", "x y".replace(" ", "")),
        ("<details><summary>s</summary>hidden</details><details open><summary>t</summary>shown</details>", "s\nt\nshown"),
    ],
)
def test_html_layout(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td>a<br>b<td>c<tr><td>long<td>d<p>e</table>", "a     c\nb\nlong  d\n\n      e"),
        ("<table><tr><td><p>x<p>y<ul><li>i<li>j</ul><pre>p  q\n r</pre></table>", "x\n\ny\n\n- i\n- j\n\np  q\n r"),
        ("<table><tr><td>n<td><table><tr><td>1<td>2<tr><td>333<td>4</table></table>", "n  1   2\n   333 4"),
        ("<table><tr><td rowspan=2>s<td>1<tr><td>2<tr><td>t<td>3</table>", "s  1\n   2\nt  3"),
        ("<table><tbody><tr><td rowspan=0>s<td>1<tr><td>2<tbody><tr><td>t<td>3</table>", "s  1\n   2\nt  3"),
        ("<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e</table>", "a  b    c\nd       e"),
    ],
)
def test_html_cells_keep_their_lines(page, text):
    assert html.extract(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></semantics></math> b", "a x=1 b"),
        ("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><text>one</text><g display=none><text>no</text></g><text>two</text></svg>z", "one two z"),
        ("<svg><title/><style/><defs/><path d='M0'/><text>seen</text><g id=a/><text>too</text></g></svg><p>after", "seen too\n\nafter"),
        ("<map name=m><p>in <a href=x>map</a><area href=y></map>", "in map"),
        ("<desc>plain</desc><defs/>page", "plainpage"),
    ],
)
def test_html_formulas_drawings_and_maps(page, text):
    assert html.extract(page) == text


def test_html_comments():
    assert html.extract("a<!-->b<!-- x -->c<!--->d<!-- y --!>e<!-- <p> -- > --> f") == "abcde f"


@pytest.mark.parametrize(
    "page",
    [
        "<table><tr><td>" + "w" * 3000 + "<td>x" + "<tr><td>a<td>b" * 4000 + "</table>",
        "<table>" + "<tr><td colspan=999><td>x" * 3000,
        "<table><tr>" + "<td>ab" * 1000 + "<tr><td colspan=999><td>x" * 1000,
        "<table><tr><td>x<td>" * 1500 + "y",
    ],
)
def test_html_padding_is_linear(page):
    text = html.extract(page)
    assert len(text) < (html.PADDING + 2) * len(page)
    assert Counter(text) - Counter(" \n" * len(text)) == Counter(html.extract(page.replace("<table>", "").replace("<tr>", "").replace("<td>", " ").replace("<td colspan=999>", " "))) - Counter(" \n" * len(page))


def test_html_columns_stay_aligned_beside_wide_cells():
    rows = [("name", "n"), ("w" * 500, "1"), *[(f"item {i}", str(i)) for i in range(30)]]
    lines = html.extract("<table>" + "".join(f"<tr><td>{a}<td>{b}" for a, b in rows)).split("\n")
    assert lines[1] == "w" * 500 + "  1"
    assert len({line.index(b, len(a)) for line, (a, b) in zip(lines[2:], rows[2:], strict=True)}) == 1


def test_html_tables_nest_to_any_depth():
    assert html.extract("<table><tr><td>" * 2000 + "a<td>b") == "a b"


WORDS = "alpha beta gamma delta epsilon".split()


def random_page(rng, depth=0):
    """A tree of (tag, attributes, children or text), well-formed, of a few kinds."""
    kind = rng.choice(["p", "div", "ul", "ol", "text", "span", "hidden", "table"] if depth < 3 else ["p", "text", "span"])
    words = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6)))
    if kind == "text":
        return words()
    if kind in ("p", "span"):
        return (kind, "", [words()])
    if kind == "hidden":
        return ("div", rng.choice([" hidden", " style='display:none'"]), [words()])
    if kind in ("ul", "ol"):
        return (kind, "", [("li", "", [words()]) for _ in range(rng.randint(1, 4))])
    if kind == "table":
        n = rng.randint(1, 4)
        return ("table", "", [("tr", "", [("td", "", [words()]) for _ in range(n)]) for _ in range(rng.randint(1, 4))])
    return ("div", "", [random_page(rng, depth + 1) for _ in range(rng.randint(1, 5))])


def to_html(node):
    return node if isinstance(node, str) else f"<{node[0]}{node[1]}>{''.join(map(to_html, node[2]))}</{node[0]}>"


def slow_text(page):
    """What the page shows, written down rule by rule: pieces of lines, line ends and blank lines."""
    out = []

    def walk(node):
        if isinstance(node, str):
            out.append(("run", node))
            return
        tag, attrs, inner = node
        if attrs:
            return
        if tag == "span":
            out.append(("run", inner[0]))
        elif tag == "div":
            out.append(("end",))
            for x in inner:
                walk(x)
            out.append(("end",))
        elif tag == "p":
            out.extend([("gap",), ("run", inner[0]), ("gap",)])
        elif tag in ("ul", "ol"):
            out.append(("gap",))
            for i, li in enumerate(inner, 1):
                out.append(("line", ("- " if tag == "ul" else f"{i}. ") + li[2][0]))
            out.append(("gap",))
        elif tag == "table":
            cells = [[td[2][0] for td in tr[2]] for tr in inner]
            wide = [max(len(r[k]) for r in cells) for k in range(len(cells[0]))]
            out.append(("gap",))
            out.extend(("line", "  ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip()) for r in cells)
            out.append(("gap",))

    walk(page)
    lines, run, blank = [], "", False
    for op, *text in [*out, ("end",)]:
        if op == "run":
            run += text[0]
            continue
        for line in ([run] if run else []) + ([text[0]] if op == "line" else []):
            lines += [""] if blank and lines else []
            lines.append(line)
            blank = False
        run = ""
        blank = blank or op == "gap"
    return "\n".join(lines)


def test_html_equals_a_slow_renderer():
    rng = random.Random(8)
    pages = [("div", "", [random_page(rng) for _ in range(rng.randint(1, 6))]) for _ in range(400)]
    for page in pages:
        assert html.extract(to_html(page)) == slow_text(page), to_html(page)


def test_html_end_tags_reach_any_depth():
    many = "<span>" * 30_000
    assert html.extract(f"<div hidden>{many}x</div>shown") == "shown"
    assert html.extract(f"<table><tr><td>{many}1<td>2<tr><td>3</table>y") == "1  2\n3\n\ny"
    assert html.extract(f"<ul><li>{many}1<li>2</ul>") == "- 1\n- 2"
    assert html.extract("<b><div hidden>x</b>" * 2 + "y</div>z</div>v") == "v"
    assert html.extract("<b><i><div>" * 20_000 + "x" + "</b></i>" * 20_000 + "y") == "xy"


def test_html_is_linear_in_depth():
    assert html.extract("<div>" * 50_000 + "x") == "x"
    assert html.extract("<table><tr><td>" * 200 + "deep") == "deep"
    assert html.extract("<p>" * 20_000 + "</div>" * 20_000 + "y") == "y"


def test_html_columns(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "<p>x"), (3, "<p>" + "w " * 200_000)], "page_id bigint, html string").withColumn("text", F.lit("clash"))
    out = html.text_column(pages).collect()
    assert sorted(len(r["text"]) for r in out) == [0, 0, 0, 1, 399_999]
    assert html.text_column(pages.limit(0)).count() == 0
