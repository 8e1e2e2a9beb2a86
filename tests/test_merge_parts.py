from pyspark.sql import functions as F

from bitekst.operators import cleaning


def test_sentences_are_merged_part_by_part(spark):
    """Results do not depend on the parts of a batch; before, a batch was turned into objects whole."""
    rows = [(i, None if i % 50 == 7 else [f"s{i}"] * (i % 5) + [" "] * (i % 2)) for i in range(3 * cleaning.MERGED_AT_ONCE + 5)]
    df = spark.createDataFrame(rows, "id long, s array<string>").coalesce(1)
    got = df.select("id", cleaning.merge_short(F.col("s"), 3).alias("m")).collect()
    assert len(got) == len(rows)
    for (_, s), row in zip(rows, sorted(got)):
        words = None if s is None else [x for x in s if x.strip()]
        assert (row.m is None) == (s is None)
        if s is not None:
            assert " ".join(row.m).split() == words and all(len(t.split()) < 3 for t in row.m)
