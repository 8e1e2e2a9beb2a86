"""Near copies around the similarity limit: links against all pairs, and rows that do not grow with their square."""

import numpy as np

from bitekst.llm import minhash
from bitekst.llm.common import stored
from tests.llm.test_minhash import plain_shingles, similarity
from tests.llm.test_simhash import groups


def near_copies(rng, count=300):
    base = [f"w{x}" for x in rng.integers(0, 100_000, 300)]
    for i in range(count):
        copy = list(base)
        for at in rng.integers(0, len(base), rng.integers(3, 6)):
            copy[at] = f"x{i}y{at}"
        yield " ".join(copy)


def test_large_group_at_the_limit(spark, monkeypatch):
    texts = list(near_copies(np.random.default_rng(5)))
    sets = [plain_shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    want = groups(near, range(len(sets)))
    assert 1 < len(set(want.values())) < len(texts)
    docs = stored(spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, at long"), "near")
    rows = {}

    def counted(df, name, *more):
        out = stored(df, name, *more)
        rows[name] = max(out.count(), rows.get(name, 0))
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    monkeypatch.setattr(minhash, "BLOCK", 64, raising=False)
    found = minhash.near_duplicates(docs, "at").collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert max(rows.values()) <= minhash.BANDS * len(texts), rows


def test_simhash_neighbours_are_candidates(spark):
    same = "one two three four five six seven eight nine ten"
    classes = [(1, 0b1011, 9), (2, 0b1011, 9), (3, 0b1000, 9), (4, -1, 9), (5, 0, 0)]
    pairs = minhash._neighbours(stored(spark.createDataFrame(classes, "node long, fp long, n int"), "classes"))
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (1, 3)}
    docs = stored(spark.createDataFrame([(1, same), (2, same.upper()), (3, "")], "row long, text string").selectExpr("row as doc_id", "row", "text"), "docs")
    marks = {r["row"]: r["fp"] for r in minhash.signatures(docs, "row").collect()}
    assert marks[1] == marks[2] != 0 == marks[3]
