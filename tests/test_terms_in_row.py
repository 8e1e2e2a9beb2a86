"""Exact term accuracy: texts and terms stay where the row is."""

from bitekst.operators import terminology as t


def test_only_numbers_move(spark):
    glossary = spark.createDataFrame(
        [("sea", "hav", 1), ("blue sea", "blått hav", 2), ("ocean", "hav", 3), ("sky", "himmel", 4)],
        "src_term string, tgt_term string, ord long",
    )
    rows = [
        (1, "The Blue Sea, the ocean.", "Et blått hav"), (2, "sky and sea", "himmelen og hav"), (3, "none", "hav"),
        (4, "sky", "sol"), (4, "rain", "Himmel"), (5, None, None), (6, "sea", None),
    ]
    df = spark.createDataFrame(rows, "pair_id long, source string, prediction string")
    out = t.term_accuracy_rows(df, glossary, fuzzy=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["pair_id"], r["term_count"], r["correct_terms"]) for r in out.collect())
    assert got == [(1, 2, 2), (2, 2, 1), (3, 0, 0), (4, 1, 1), (4, 1, 1), (5, 0, 0), (6, 1, 0)]

    by_join = t.term_accuracy_rows(df, glossary, fuzzy=False, walk_bytes=0)
    assert sorted(map(tuple, by_join.collect())) == sorted(map(tuple, out.collect()))
    assert plan.count("ArrowEvalPython") == 1 and "tgt_term" not in plan
