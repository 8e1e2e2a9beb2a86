"""Near-duplicates of the pipeline against the similarity of all pairs."""

import numpy as np

import corpus_pipeline as pipeline
from bitekst.llm import minhash
from bitekst.llm.common import stored
from tests.llm import odd
from tests.llm.test_simhash import groups


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def families(rng):
    """Texts with copies of which ever more words are replaced, chains of copies of copies included."""
    texts = []
    for f in range(25):
        base = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(40, 400))]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05, 0.1):
            copy = [f"x{rng.integers(5000)}" if rng.random() < share else w for w in base]
            texts.append(" ".join(copy))
            if f % 2:
                base = copy
    return [texts[i] for i in rng.permutation(len(texts))]


def test_recall_against_all_pairs(spark):
    texts = [*families(np.random.default_rng(11)), "one two", "One  TWO", "one three", "", " \n", None]
    sets = [plain_shingles(t) for t in texts]
    near = [
        (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similarity(sets[i], sets[j]) >= 0.8
    ]
    want = groups(near, range(len(sets)))
    assert sum(similarity(sets[i], sets[j]) < 0.95 for i, j in near) > 20
    docs = stored(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "docs")
    kept = {r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i in want if want[i] == i}
    numbers = stored(docs.selectExpr("*", "doc_id + 7 as place"), "numbered")
    found = minhash.near_duplicates(numbers, "place").collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want


def test_odd_documents(spark):
    for rows in (odd.TEXTS, []):
        docs = stored(odd.documents(spark, rows), "odd")
        out = pipeline.near_dedup(spark, docs, "")
        assert out.columns == docs.columns
        got = [r["doc_id"] for r in out.collect()]
        assert len(got) == (8 if rows else 0) and set(got) >= ({1, 2, 5, 6, 7, 8, None} if rows else set())
