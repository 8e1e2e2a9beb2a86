import itertools

import numpy as np
import pytest

from bitekst.operators import alignment as al
from bitekst.operators import assignment
from tests.test_alignment import cosines, found, make


def best_total(value):
    """The largest total of all assignments of a small matrix."""
    value = value if value.shape[0] <= value.shape[1] else value.T
    n, m = value.shape
    return max(sum(value[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))


def test_solver_against_all_assignments():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 6))
        m = int(rng.integers(n, 7))
        value = np.round(rng.uniform(-1, 1, (n, m)), int(rng.integers(0, 4)))  # few digits: many ties
        column = assignment.assign(value)
        assert len(set(column)) == n
        assert value[np.arange(n), column].sum() == pytest.approx(best_total(value))


#: The best pair of all (en 0 with no 0) leaves en 1 with an opposite vector; no third pair helps.
TRAP = ([[1.0, 0.0], [0.8, 0.6], [0.0, -1.0], [0.1, -1.0]], [[0.98, 0.199], [0.6, -0.8]])


def test_mutual_best_is_worse(spark):
    docs = make(spark, {1: TRAP, 2: (np.eye(5), np.eye(5)[2:]), 3: ([[1, 0]] * 4, [[1, 0]] * 2), 4: ([[1, 0]], [])})
    pairs = assignment.best_in_tasks(docs)
    totals = {r.doc_id: r.s for r in pairs.groupBy("doc_id").agg({"similarity": "sum"}).toDF("doc_id", "s").collect()}
    assert totals == pytest.approx({1: best_total(cosines(*TRAP)), 2: 3.0, 3: 2.0})
    greedy = sum(r.similarity for r in al.align_one_to_one(docs.filter("doc_id = 1"), -2.0).collect())
    assert greedy <= totals[1]
    assert {(r.doc_id, r.no_pos) for r in pairs.collect()} == {(1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1)}


def test_threshold_applies_after_the_assignment(spark):
    a, b = [[1.0, 0.0], [0.9, 0.4358898943540673]], [[0.9, 0.4358898943540673], [0.5, 0.8660254037844386], [-1.0, 0.0], [0.0, -1.0]]
    docs = make(spark, {1: (a, b)})
    value = cosines(a, b)
    assert value[0, 0] + value[1, 1] > value[1, 0] + value[0, 1]
    # Greedily en 1 takes its twin; the best assignment gives that to en 0.
    assert found(al.align_one_to_one(docs, 0.75)) == {(1, 0)}
    assert found(assignment.align_assignment(docs, 0.75)) == {(0, 0), (1, 1)}
    assert found(assignment.align_assignment(docs, 0.85)) == {(0, 0)}


@pytest.mark.parametrize("block, epsilon", [(3, 0.2), (256, 0.4)])
def test_auction_comes_near_the_best(spark, block, epsilon):
    rng = np.random.default_rng(5)
    docs, best = {}, {}
    for d, (n, m) in enumerate([(5, 7), (7, 4), (1, 3)]):
        docs[d] = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
        best[d] = best_total(cosines(*docs[d]))
    pairs = assignment.best_by_auction(make(spark, docs), epsilon=epsilon, block=block).collect()
    for d, (a, b) in docs.items():
        own = [r for r in pairs if r.doc_id == d]
        size = min(len(a), len(b))
        assert len(own) == len({r.en_pos for r in own}) == len({r.no_pos for r in own}) == size
        assert all(r.similarity == pytest.approx(cosines(a, b)[r.en_pos, r.no_pos]) for r in own)
        assert sum(r.similarity for r in own) >= best[d] - size * epsilon - 1e-9


def test_long_documents_are_auctioned(spark):
    eye = np.eye(6)
    docs = make(spark, {1: (eye, eye[2:]), 2: (eye[:3], eye[:2])})
    got = assignment.align_assignment(docs, task_sentences=6)
    assert {(r.doc_id, r.en_pos, r.no_pos) for r in got.collect()} == {(1, i + 2, i) for i in range(4)} | {(2, 0, 0), (2, 1, 1)}


def test_empty(spark):
    docs = make(spark, {1: ([[1, 0]], [[1, 0]])}).filter("false")
    assert assignment.align_assignment(docs).count() == 0
    assert assignment.best_by_auction(docs).count() == 0
