"""Alignment from texts: texts are split once, and vectors alone are enough to align."""

import pytest
from pyspark.sql import functions as F

from bitekst.operators import alignment, cleaning
from bitekst.operators.assignment import align_assignment
from bitekst.plans import inputs

ONE, TWO, THREE = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
ZERO = [0.0, 0.0, 0.0]


def sentences(spark):
    """A document paired by position, one that needs matching, both with zero vectors at equal
    positions, and one that lacks a side."""
    docs = {
        1: ([ONE, TWO, ZERO], [ONE, ONE, ZERO]),
        2: ([ZERO, TWO, THREE, ONE], [ZERO, THREE]),
        3: ([ONE], []),
    }
    rows = [
        (doc, side, pos, f"{side}{pos}", v)
        for doc, sides in docs.items()
        for side, vectors in zip(("en", "no"), sides)
        for pos, v in enumerate(vectors)
    ]
    return spark.createDataFrame(rows, "doc_id long, side string, pos long, sent string, v array<double>")


@pytest.mark.parametrize("match", [alignment.align_one_to_one, align_assignment])
def test_texts_may_be_left_out(spark, match):
    given = sentences(spark)
    whole = alignment.align_documents(given, match=match)
    bare = alignment.align_documents(given.drop("sent"), match=match)
    assert {(r.doc_id, r.en, r.no) for r in whole.collect()} == {(1, "en0", "no0"), (2, "en2", "no1")}
    assert bare.columns == [c for c in whole.columns if c not in ("en", "no")]
    assert sorted(bare.collect()) == sorted(whole.drop("en", "no").collect())


def test_vectors_move_once(spark):
    """No join on the way to the pairs by position sends the vectors a second time."""
    given = sentences(spark).filter("doc_id = 1").drop("sent")
    plan = alignment.align_documents(given)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Aggregate" not in plan


@pytest.fixture
def folder(spark, tmp_path):
    rows = [
        (0, "no: here are seven words, no fewer, indeed.\nAnd this is the last line of all of them here.", "no"),
        (1, "One line of more than ten words stands here all by itself.\nAnother line that has more than ten words is the last.", "no"),
        (2, "Too short.", "no"),
        (3, "A single line of five.", "no"),
        (4, None, "no"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_texts_are_split_once(spark, folder):
    split, merged = inputs.merged_sentences(spark, folder)
    assert not [f for df in (split, merged) for f in df.inputFiles() if "documents.parquet" in f]


def test_sides_of_merged_sentences(spark, folder):
    split, merged = inputs.merged_sentences(spark, folder)
    counts = {(r.doc_id, r.side): r["count"] for r in split.groupBy("doc_id", "side").count().collect()}
    assert counts == {(0, "en"): 2, (0, "no"): 2, (1, "en"): 2, (1, "no"): 1, (3, "en"): 1}
    rows = {(r.doc_id, r.side, r.pos): r for r in merged.collect()}
    assert sorted(rows) == [(0, "en", 0), (0, "en", 1), (0, "no", 0), (0, "no", 1), (1, "en", 0), (1, "en", 1), (1, "no", 0), (3, "en", 0)]
    for (_, side, _), r in rows.items():
        text = r.sent.removeprefix("no: ")
        assert r.v == [float(text.count(c) + 1) for c in "aeiounrs"]
        assert side == "en" or r.sent.startswith("no: ")
    assert rows[0, "no", 0].sent == "no: no: here are seven words, no fewer, indeed."


def test_whitespace_of_all_kinds_is_cleaned(spark):
    """The whole text is cleaned before it is cut; before, each sentence was."""
    kinds = [c for c in map(chr, range(0x3001)) if c.isspace() and c != "\n"] + ["\x01"]
    text = "".join(f" \t{c}a{c}{c}\u00e9 {c}B c{c}.{c}\n{c}\n" for c in kinds)
    others = "\u200b\u180e\ufeff\U0001f600 x\u00a1y \u167f z"
    got = spark.createDataFrame([(text + others,)], "t string").select(cleaning.split_sentences(F.col("t"))).first()[0]
    assert got == ["a \u00e9 B c ."] * len(kinds) + [others]
