import numpy as np
import xxhash

from bitekst.llm import simhash
from bitekst.llm.common import components
from tests.llm import odd


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_odd_documents(spark):
    docs = odd.documents(spark)
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["fp"] % (1 << 64))
    for doc_id, text, *_ in odd.TEXTS:
        assert plain_fingerprint(text) in by[doc_id]
    empty = [r for r in out if r["fp"] == 0]
    # null, empty and blank texts are one group, named by its smallest id
    assert {r["doc_id"] for r in empty} == {2, 3, 4, None}
    assert {r["component_id"] for r in empty} == {2}
    # the two texts of doc_id 1 are groups of one name; of each group one row stays
    assert sum(r["stays"] for r in out) == len({r["fp"] for r in out}) == 8


def test_no_documents(spark):
    assert simhash.near_duplicates(odd.documents(spark, [])).collect() == []


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set()
    for x in base.tolist():
        fps.add(x)
        for _ in range(25):  # families around a fingerprint, also chains
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            fps.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    near = [
        (a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) % (1 << 64)).count("1") <= 3
    ]
    want = groups(near, signed)
    classes = spark.createDataFrame([(x,) for x in signed], "fp long")
    for heavy in (4096, 3):  # the second splits nearly every key by pivot cells
        found = [(r["a"], r["b"]) for r in simhash.links(classes, heavy).collect()]
        assert all(bin((a ^ b) % (1 << 64)).count("1") <= 64 for a, b in found)
        assert groups(found, signed) == want


def test_pivot_bound():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x ^ np.uint64(0b1011)
    table = lambda v: np.bitwise_count(v[:, None] ^ np.array(simhash.PIVOTS, np.uint64)).astype(int)
    assert np.abs(table(x) - table(y)).max() <= 3


def test_components(spark):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 560)]
    loose = [tuple(map(int, rng.integers(1000, 1100, 2))) for _ in range(80)]
    edges = chain + star + loose + [(7, 7), (5, None), (None, 6)] + star[:3]
    nodes = {n for e in edges if None not in e and e[0] != e[1] for n in e}
    want = groups([e for e in edges if None not in e], {n for e in edges for n in e if n is not None})
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: want[n] for n in nodes}
