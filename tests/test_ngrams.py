import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from bitekst.functions import ngrams, scores
from bitekst.plans import inputs


def test_tokens_inside_a_task_are_those_of_the_rules(spark):
    rng = random.Random(3)
    parts = ["a", "B", "5", "12", ".", ",", "-", "-\n", "\n", " ", "  ", "\u00a0", "\u2003", "\x1c", "&amp;", "&quot;",
             "&lt;", "<skipped>", "(", ")", "'", "/", "@", "~", "`", "_", "å", "\U0001f600"]
    texts = ["", " ", *("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(1500))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scores.tokens(F.col("t")).alias("w"))
    for row in df.collect():
        assert scores.token_list(row.t) == row.w, row.t


def test_counts_that_fit_no_machine_word_are_the_same():
    rng = np.random.default_rng(4)
    sizes = [rng.integers(0, 30, 12), rng.integers(0, 30, 12)]
    units = rng.integers(0, 4, sum(s.sum() for s in sizes))
    sparse = units * (1 << 12)
    assert (ngrams._counts(units, *sizes, 6) == ngrams._counts(sparse, *sizes, 6)).all()


def test_a_batch_is_counted_part_by_part(monkeypatch):
    """What is held at once does not follow the size of a batch."""
    seen = []
    cut = ngrams._words
    texts = pa.array(["one two three four five"] * 2000)

    def watched(part):
        seen.append(sum(map(len, part)))
        return cut(part)

    monkeypatch.setattr(ngrams, "UNITS", 1000)
    out = ngrams._by_part(texts, texts, 4, watched)
    assert max(seen) < 1200 and (out[0].T == [5, 4, 3, 2]).all()


def test_pairs_of_a_file_with_one_row_group_use_all_cores(spark):
    p = inputs.pairs(spark, "/root/testdata/sf0.001")
    held = p.select(F.spark_partition_id()).distinct().count()
    assert held >= min(spark.sparkContext.defaultParallelism, 8)
