import numpy as np
from pyspark.sql import functions as F

from bitekst.llm import covertree


def plain(rows, k, is_query):
    vectors = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors.setdefault(i, []).append([int(np.floor(256 * float(np.float32(x)))) for x in v])
    out = []
    for q in vectors:
        if q is None or not is_query(q):
            continue
        own = min(vectors[q])
        found = [
            (-sum(a * b for a, b in zip(own, v)), i is None, i or 0, i) for i, vs in vectors.items() if i != q for v in vs
        ]
        found.sort(key=lambda x: x[:3])
        out += [(q, r + 1, f[3], -f[0]) for r, f in enumerate(found[:k])]
    return sorted(map(str, out))


def got(spark, rows, k=5, sample=64, block=50):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = covertree.top_k(df, F.col("vec_id") % 5 == 0, k, sample=sample, block=block)
    return sorted(str((r["query_id"], r["rank"], r["vec_id"], r["score"])) for r in out.collect())


def test_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(6, 12)) * 3
    near = [(i, (centers[i % 6] + 0.1 * rng.normal(size=12)).tolist()) for i in range(400)]
    loose = [(i, rng.normal(size=12).tolist()) for i in range(300)]
    equal = [(i, [1.0, -0.5]) for i in range(120)] + [(i, [0.0, 0.0]) for i in range(120, 140)]
    for rows in (near, loose, equal):
        assert got(spark, rows) == plain(rows, 5, lambda q: q % 5 == 0)


def test_odd(spark):
    rows = [
        (0, [0.5, 0.25, -1.0]), (5, [1.0, 2.0]), (5, [0.0, 0.0]), (7, None), (8, [1.0, None]), (9, [float("nan"), 1.0]),
        (11, [float("inf"), 0.0]), (12, []), (None, [3.0, 3.0, 3.0]), (None, None), (13, [-0.001, 1e-9, -0.0]), (14, [2.0]),
    ]
    assert got(spark, rows) == plain(rows, 5, lambda q: q % 5 == 0)
    assert got(spark, rows[:1]) == []
    assert got(spark, []) == []


def test_large_components(spark):
    rows = [(i, [3.0e38 * (1 if i % 2 else -1), 1.0]) for i in range(8)] + [(20 + i, [1e15 + i, 2.0**40]) for i in range(5)]
    lines = got(spark, rows, k=2)
    top = 2**63 - 1
    assert str((0, 1, 2, top)) in lines  # beyond 64 bits: the nearest number


def test_scores_of_sums_beyond_doubles():
    a = np.array([[2.0**40, 1.0]])
    b = np.array([[2.0**20, 3.0], [2.0**20, 1.0]])
    assert covertree.inner(a, b).tolist() == [[2**60 + 3, 2**60 + 1]]


def test_tree_covers_its_points():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(700, 5))
    points[100:200] = points[0]
    tree = covertree.cover_tree(points, leaf=20)
    seen, stack = [], [tree]
    while stack:
        node = stack.pop()
        d = np.sqrt(((points[node.rows] - node.center) ** 2).sum(axis=1))
        assert d.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            stack += node.children
        else:
            assert len(node.rows) <= 20 or node.radius == 0
            seen += node.rows.tolist()
    assert sorted(seen) == list(range(700))


def test_bound_holds():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.floor(rng.normal(size=(30, 8)) * 256 + rng.normal(size=8) * 300) for _ in range(2))
        q, p = covertree.cover_tree(a), covertree.cover_tree(b)
        assert covertree.bound(q, p) >= (a @ b.T).max()
