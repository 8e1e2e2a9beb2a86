import random

import pytest

from bitekst.llm import mixing
from tests.llm.odd import documents

SF = "/root/testdata/sf0.01"


def plain_targets(sizes, weights, most):
    """Cap and share again until no target is above its bound."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if share * weight[s] > most * sizes[s]}
        if not above:
            return {s: most * float(sizes[s]) if s in capped else share * weight[s] for s in names}
        capped |= above


@pytest.mark.parametrize("most", [1.01, 2, 3])
def test_targets(spark, most):
    rng = random.Random(5)
    for _ in range(3):
        sizes = {f"s{i}é{chr(65 + i % 40)}": int(10 ** rng.uniform(0, 5)) for i in range(23)} | {None: 700, "none": 0}
        rows = [(s, n // 2) for s, n in sizes.items()] + [(s, n - n // 2) for s, n in sizes.items()]
        got = mixing.targets(spark.createDataFrame(rows, "source string, size long"), most=most).collect()
        want = plain_targets(sizes, mixing.WEIGHTS, most)
        assert {r["source"]: r["source_size"] for r in got} == sizes
        for r in got:
            assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.op11(spark, SF).collect()
    plain = {r["doc_id"]: r for r in docs.collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(plain)
    taken, goal, size = {}, {}, {}
    for r in rows:
        doc = plain[r["doc_id"]]
        assert r["size"] == len(doc["text"].encode().split())
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[doc["source"]] = taken.get(doc["source"], 0) + r["taken"]
        size[doc["source"]] = size.get(doc["source"], 0) + r["size"]
        goal[doc["source"]] = r["target"]
    want = plain_targets(size, mixing.WEIGHTS, mixing.MOST)
    for s in size:
        assert goal[s] == pytest.approx(want[s])
        assert abs(taken[s] - goal[s]) <= 0.005 * goal[s]
    again = mixing.op11(spark, SF).collect()
    assert sorted(rows) == sorted(again)
    n = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert sorted(mixing.op11(spark, SF).collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_walk_keeps_totals_and_probabilities():
    """Expected words and documents do not change on a walk; on average every document is taken with
    its probability."""
    rng = random.Random(1)
    sizes = [rng.randint(64, 127) for _ in range(40)] + [100, 100]
    wins = [0.0] * len(sizes)
    for seed in range(600):
        done = list(mixing.walk(([0.3, s, i] for i, s in enumerate(sizes)), random.Random(seed).random))
        assert len(done) == len(sizes)
        assert sum(0 < u[0] < 1 for u in done) <= 2
        assert sum(u[0] * u[1] for u in done) == pytest.approx(0.3 * sum(sizes))
        assert sum(u[0] for u in done) == pytest.approx(0.3 * len(sizes))
        for u in done:
            wins[u[2]] += u[0] / 600
    assert max(abs(w - 0.3) for w in wins) < 0.08


def test_landing_takes_the_best_choice():
    units = [[0.5, s] for s in (900, 70, 40, 33, 8)]
    off = abs(sum((u[0] - 0.5) * u[1] for u in mixing.land(units)))
    best = min(abs(sum(((m >> i & 1) - 0.5) * s for i, s in enumerate((900, 70, 40, 33, 8)))) for m in range(32))
    assert off == best
    assert mixing.land([]) == []


def test_levels_of_walks(spark, monkeypatch):
    """Many walks that meet in fewer, with one source of most rows, copies and documents of no words."""
    monkeypatch.setattr(mixing, "WALK", 20)
    monkeypatch.setattr(mixing, "MEET", 8)
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 200), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)] + [(7, "same text", "copies")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9)
    out = mixing.mix(docs).collect()
    assert len(out) == 3500
    totals = {}
    for r in out:
        t = totals.setdefault((r["target"], r["source_size"]), [r["target"], r["source_size"], 0, 0])
        t[2] += r["taken"]
        t[3] += r["size"]
    for goal, size, taken, seen in totals.values():
        assert seen == size
        assert abs(taken - goal) <= max(2, 0.002 * goal)


def test_odd_rows(spark):
    rows = mixing.mix(documents(spark)).collect()
    assert len(rows) == 12
    assert sorted((r["doc_id"] or 0, r["size"]) for r in rows)[:2] == [(0, 0), (0, 9)]
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(documents(spark).limit(0)).collect() == []
    blank = mixing.mix(documents(spark).filter("doc_id in (2, 3, 4)")).collect()
    assert [(r["target"], r["taken"]) for r in blank] == [(0.0, 0)] * 3
