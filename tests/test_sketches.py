import numpy as np
import pytest
from pyspark.sql import functions as F

from bitekst.functions import sketches


def within(value, scores, p):
    scores = np.asarray(scores)
    return (scores < value).mean() <= p + sketches.RANK_ERROR and (scores <= value).mean() >= p - sketches.RANK_ERROR


def test_merged_batches_keep_the_rank_error(spark):
    n = 60_000
    x = F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.abs(F.hash("id")) % 100_003 / 100_003.0)
    rows = spark.range(n).select((F.col("id") % 7).alias("batch"), F.lit("de").alias("lang"), x.alias("s"))
    exact = [r.s for r in rows.collect()]
    stored = sketches.score_sketches(rows, ["lang", "batch"], "s")
    assert stored.count() == 7
    one = sketches.distribution(sketches.score_sketches(rows, ["lang"], "s")).first()
    half = sketches.merge_sketches(stored.filter("batch < 3"), ["lang"])
    rest = sketches.merge_sketches(stored.filter("batch >= 3"), ["lang"])
    for merged in (stored, half.unionByName(rest)):
        row = sketches.distribution(sketches.merge_sketches(merged, ["lang"])).first()
        assert (row["rows"], row["min"], row["max"]) == (n, min(exact), max(exact)) == (one["rows"], one["min"], one["max"])
        assert row["mean"] == pytest.approx(np.mean(exact)) and row["std"] == pytest.approx(np.std(exact))
        assert all(within(row[c], exact, p) for c, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)))
    # a sketch does not grow with the scores
    assert sketches.score_sketches(rows, [], "s").select(F.length("sketch")).first()[0] < 40_000


def test_small_groups_are_exact(spark):
    rows = spark.createDataFrame(
        [("a", 1, float(i)) for i in range(9)]
        + [("b", 1, 2.0), ("c", 1, None), ("d", 1, float("nan")), ("d", 1, 5.0), (None, 1, 1.0), ("a", 2, 100.0)],
        "lang string, batch int, s double",
    )
    merged = sketches.merge_sketches(sketches.score_sketches(rows, ["lang", "batch"], "s"), ["lang"])
    got = {r.lang: r for r in sketches.distribution(merged).collect()}
    assert set(got) == {"a", "b", "d", None}
    assert (got["a"].rows, got["a"]["median"], got["a"]["max"]) == (10, 4.0, 100.0)
    assert (got["b"]["std"], got["b"]["q25"], got["b"]["q75"]) == (0.0, 2.0, 2.0)
    assert (got["d"].rows, got["d"]["mean"]) == (1, 5.0)
    assert sketches.score_sketches(rows.limit(0), ["lang"], "s").count() == 0
