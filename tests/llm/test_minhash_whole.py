"""Nothing that is similar enough is left out before it is compared exactly."""

import numpy as np
from pyspark.sql import functions as F

from bitekst.llm import minhash
from bitekst.llm.common import stored
from tests.llm.test_minhash import families, plain_shingles, similarity
from tests.llm.test_simhash import groups


def test_all_simhash_neighbours_are_compared(spark, monkeypatch):
    """Rows that share no band, connected by their SimHashes only. Before, the classes of one SimHash were
    compared with the first of them, and others with the first ones along a spanning forest."""
    texts = families(np.random.default_rng(3))[:60]
    sets = [plain_shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    want = groups(near, range(len(sets)))
    assert any(want[i] == j != 0 for i, j in near)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, at long")
    docs, plain = stored(docs, "docs"), minhash.signatures
    for fp in (F.lit(5), F.expr("shiftleft(1L, cast(row % 60 as int))")):  # one, or all two bits apart

        def marked(*a, fp=fp):
            alone = F.transform("bands", lambda x: F.xxhash64(x, "row"))
            return plain(*a).withColumns({"fp": fp.cast("long"), "bands": alone})

        monkeypatch.setattr(minhash, "signatures", marked)
        monkeypatch.setattr(minhash, "BLOCK", 16)
        found = minhash.near_duplicates(docs, "at").collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_places_rule_out_no_similar_pair():
    """Not a matter of luck: the bound holds for any hashes, also if all fall on few places."""
    rng = np.random.default_rng(4)
    for _ in range(2000):
        size, step = int(rng.choice([1, 4, 9, 60, 700, 6000])), int(rng.choice([1, 512, 1024, 2048]))
        both = np.unique(rng.integers(0, 1 << 40, 2 * size)).astype(np.uint64) * np.uint64(step)
        share = rng.random() * 0.3
        x, y = (both[rng.random(len(both)) >= share] for _ in range(2))
        apart = minhash._apart(*(np.frombuffer(minhash.odd_places(h), np.uint64) for h in (x, y)))
        same = len(np.intersect1d(x, y))
        assert apart <= len(x) + len(y) - 2 * same
        if same >= 0.8 * (len(x) + len(y) - same):
            assert minhash._may_reach(apart, np.int64(len(x) + len(y)), 0.8)
    for k in range(1, 4000):  # pairs at the limit itself: 4k of 5k shingles in common
        assert minhash._may_reach(np.int64(k), np.int64(9 * k), 0.8)


def test_different_texts_are_ruled_out(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(30)]
    docs = stored(spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, at long"), "docs")
    own = stored(minhash.signatures(docs, "at").withColumnRenamed("row", "node"), "own")
    pairs = own.select(F.col("node").alias("a")).crossJoin(own.select(F.col("node").alias("b"))).filter("a < b")
    assert pairs.count() == 435 and minhash.likely(pairs, own).count() == 0
