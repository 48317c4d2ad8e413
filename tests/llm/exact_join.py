"""Compare near-duplicate components with an exact join over a whole table, in one process.

    python tests/llm/exact_join.py /root/testdata/check_h 2

Distinct sets are joined on prefixes: ordered by frequency, two sets at 0.8 or more share one of
the first n - ceil(0.8 n) + 1 shingles of either. Every candidate that is not yet in one
component is counted on the full sets. Nothing is hashed but the shingles, to 64 bits by
blake2b, independently of the operator.
"""

import hashlib
import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def exact(rows, size, percent=80):
    """{id: (set size, component)} of rows (id, text)."""
    number: dict[bytes, int] = {}
    sets, of = {}, defaultdict(list)
    for i, text in rows:
        w = (text or "").encode().lower().split()
        grams = {b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        own = frozenset(number.setdefault(hashlib.blake2b(g, digest_size=8).digest(), len(number)) for g in grams)
        sets[i] = len(own)
        if own:
            of[own].append(i)
    count = Counter(g for s in of for g in s)
    nodes = sorted(of, key=len)
    up = list(range(len(nodes)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    index = defaultdict(list)
    for n, s in enumerate(nodes):
        order = sorted(s, key=lambda g: (count[g], g))
        prefix = order[: len(s) - -(-percent * len(s) // 100) + 1]
        seen = set()
        for g in prefix:
            for m in index[g]:
                if m not in seen:
                    seen.add(m)
                    if 100 * len(nodes[m]) >= percent * len(s) and root(m) != root(n):
                        both = len(s & nodes[m])
                        if 100 * both >= percent * (len(s) + len(nodes[m]) - both):
                            up[root(m)] = root(n)
        for g in prefix:
            index[g].append(n)
    least = {}
    for n, s in enumerate(nodes):
        least[root(n)] = min(least.get(root(n), of[s][0]), *of[s])
    component = {i: least[root(n)] for n, s in enumerate(nodes) for i in of[s]}
    return {i: (k, component.get(i, i)) for i, k in sets.items()}


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from driftmap.llm import minhash

    where, size = sys.argv[1], int(sys.argv[2])
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "16").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{where}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, size=size).toLocalIterator()}
    want = exact(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").toLocalIterator()), size)
    print(f"{where}: {len(want)} documents, shingles of {size}: {sum(got[i] != x for i, x in want.items())} differ; {len({c for _, c in want.values()})} components")
