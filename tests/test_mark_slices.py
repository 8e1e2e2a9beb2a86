"""Marking takes a batch a few texts at a time."""

from pyspark.sql import functions as F

from bitekst.operators import terminology as t


def test_rows_of_several_slices(spark):
    glossary = spark.createDataFrame([("blue sea", "x", 1), ("term", "y", 2)], "src_term string, tgt_term string, ord long")
    text = F.expr("case id % 4 when 0 then 'the Blue Sea ' || id when 1 then 'a term <b> ' || id when 2 then null else 'none' end")
    df = spark.range(0, 3 * t.TEXTS + 7, 1, 1).select(F.col("id").alias("pair_id"), text.alias("source"))
    got = {r["pair_id"]: r["source"] for r in t.mark_terms(df, glossary).collect()}
    by_join = {r["pair_id"]: r["source"] for r in t.mark_terms(df, glossary, walk_bytes=0).collect()}
    assert got == by_join and ">blue sea<" in got[0] and got[2] is None
