import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitekst.functions.quantiles import quantiles
from bitekst.functions.scores import tokens
from bitekst.operators import scoring

ROWS = [
    (1, "the cat sat on the mat", "the cat sat on the mat"),
    (2, "the the the the the the", "the cat sat on the mat"),
    (3, "one two three", "one two three"),
    (4, "", "something here now please"),
    (5, "something here now please", ""),
    (6, "a b c d e f g h", "a b c d x f g h i j"),
    (7, "blåbær og øl på kjøkkenet i dag", "øl og blåbær på kjøkkenet i går"),
    (8, "ab", "ab cd"),
    (9, "", ""),
    (10, "x" * 200 + " yz", "x" * 197 + " yz"),
]


def pairs(spark):
    return spark.createDataFrame(ROWS, "pair_id long, prediction string, reference string")


def grams(units, n):
    return Counter(tuple(units[i : i + n]) for i in range(len(units) - n + 1))


def plain_bleu(rows):
    match, possible, hyp_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for hyp, ref in rows:
        h, r = hyp.split(), ref.split()
        hyp_len, ref_len = hyp_len + len(h), ref_len + len(r)
        for n in range(1, 5):
            match[n - 1] += sum((grams(h, n) & grams(r, n)).values())
            possible[n - 1] += max(len(h) - n + 1, 0)
    if min(match) == 0 or not hyp_len or not ref_len:
        return 0.0
    mean = sum(math.log(m / p) for m, p in zip(match, possible)) / 4
    return (1 if hyp_len > ref_len else math.exp(1 - ref_len / hyp_len)) * math.exp(mean)


def plain_chrf(rows):
    counts = [[0, 0, 0] for _ in range(6)]
    for hyp, ref in rows:
        h, r = "".join(hyp.split()), "".join(ref.split())
        for n in range(1, 7):
            gh, gr = grams(h, n), grams(r, n)
            counts[n - 1][0] += sum((gh & gr).values())
            counts[n - 1][1] += sum(gh.values()) if gr else 0
            counts[n - 1][2] += sum(gr.values())
    both = [c for c in counts if c[1] and c[2]]
    if not both:
        return 0.0
    p = sum(m / h for m, h, _ in both) / len(both)
    r = sum(m / r for m, _, r in both) / len(both)
    return 500 * p * r / (4 * p + r) if p + r else 0.0


def test_rows_match_plain_formulas(spark):
    got = {r.pair_id: r for r in scoring.row_scores(pairs(spark)).collect()}
    assert len(got) == len(ROWS)
    for row_id, hyp, ref in ROWS:
        assert got[row_id].bleu == pytest.approx(plain_bleu([(hyp, ref)]))
        assert got[row_id].chrf == pytest.approx(plain_chrf([(hyp, ref)]))
    assert got[1].bleu == pytest.approx(1.0) and got[1].chrf == pytest.approx(100.0)
    assert got[3].bleu == 0.0  # fewer than four tokens
    assert got[4].bleu == got[4].chrf == 0.0


def test_equal_ids_are_separate_rows(spark):
    rows = [(1, "a b c d e", "a b c d e"), (1, "a b c d x", "a b c d e"), (1, None, "a")]
    df = spark.createDataFrame(rows, "pair_id long, prediction string, reference string")
    got = sorted(r.bleu for r in scoring.bleu_sentence(df).collect())
    want = sorted([1.0, plain_bleu([rows[1][1:]]), 0.0])
    assert got == pytest.approx(want)
    assert scoring.chrf_sentence(df).count() == 3


def test_counts_do_not_depend_on_the_slices(monkeypatch):
    from bitekst.functions import ngrams

    rng = np.random.default_rng(2)
    sizes = [rng.integers(0, 40, 30), rng.integers(0, 40, 30)]
    units = rng.integers(0, 5, sum(s.sum() for s in sizes))
    whole = ngrams._counts(units, *sizes, 4)
    hyp, ref = np.split(units, [sizes[0].sum()])
    monkeypatch.setattr(ngrams, "UNITS", 50)
    parts = ngrams._parts(sizes[0] + sizes[1])
    assert len(parts) > 5
    for a, b in parts:
        cut = [np.split(u, np.cumsum(s)[:-1])[a:b] for u, s in zip((hyp, ref), sizes)]
        part = ngrams._counts(np.concatenate([*cut[0], *cut[1]]), sizes[0][a:b], sizes[1][a:b], 4)
        assert (part == whole[:, :, a:b]).all()


def test_corpus_pools_counts(spark):
    rows = [(h, r) for _, h, r in ROWS]
    report = scoring.evaluate_all(pairs(spark)).first()
    assert report.bleu == pytest.approx(plain_bleu(rows))
    assert report.chrf == pytest.approx(plain_chrf(rows))


def test_corpus_of_one_row_is_the_row(spark):
    one = pairs(spark).filter("pair_id = 6")
    assert scoring.bleu_corpus(one).first().bleu == pytest.approx(
        scoring.bleu_sentence(one).first().bleu
    )


def test_empty_corpus(spark):
    empty = pairs(spark).filter("false")
    assert scoring.bleu_corpus(empty).first().bleu == 0.0
    assert scoring.chrf_corpus(empty).first().chrf == 0.0
    assert scoring.score_distribution(scoring.bleu_sentence(empty)).count() == 0


def test_partitioning_does_not_matter(spark):
    a = scoring.evaluate_all(pairs(spark)).first()
    b = scoring.evaluate_all(pairs(spark).orderBy(F.rand(1)).repartition(5)).first()
    assert [round(x, 12) for x in a] == [round(x, 12) for x in b]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Hello, world.", ["Hello", ",", "world", "."]),
        ("1,000.5 kr", ["1,000.5", "kr"]),
        ("3-4 well-known", ["3", "-", "4", "well-known"]),
        ("a &amp; b &lt;c&gt;", ["a", "&", "b", "<", "c", ">"]),
        ("line-\nbreak and\nmore", ["linebreak", "and", "more"]),
        ("<skipped>(x)", ["(", "x", ")"]),
        ("", []),
    ],
)
def test_tokens(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tokens(F.col("t"))).first()[0] == expected


def test_error_classes(spark):
    rows = [
        ("a b", "a b c d e", "under_generation"),
        ("a b c d e f g h", "a b c d", "over_generation"),
        ("x y z d", "a b c d", "semantic_drift"),
        ("a b c x", "a b c d", "minor_error"),
        ("a b", "a b c d", "minor_error"),  # exactly half is not below half
        ("", "", "minor_error"),
    ]
    df = spark.createDataFrame(rows, "h string, r string, want string")
    for row in df.select("want", scoring.error_class(F.col("h"), F.col("r"))).collect():
        assert row[0] == row[1]


def test_worst_rows_are_listed_in_order(spark):
    listed = scoring.error_samples(pairs(spark).withColumn("source", F.lit("s")), top=4).collect()
    scored = sorted((plain_bleu([(h, r)]), i) for i, h, r in ROWS)
    assert [r.pair_id for r in listed] == [i for _, i in scored[:4]]
    counts = scoring.error_class_counts(
        spark.createDataFrame(listed)
    ).agg(F.sum("rows")).first()[0]
    assert counts == 4


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([np.zeros(700), rng.random(1300), [0.5] * 300, [1.0]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = spark.range(1).select(quantiles(df, "x", probs, 0.0, 1.0, bins=64)).first()[0]
    assert got == pytest.approx(list(np.quantile(values, probs)))


def test_distribution(spark):
    scores = [0.0, 0.0, 0.2, 0.4, 0.9]
    df = spark.createDataFrame([(s,) for s in scores], "bleu double")
    row = scoring.score_distribution(df).first()
    assert row.mean == pytest.approx(np.mean(scores))
    assert row["std"] == pytest.approx(np.std(scores))
    assert (row.median, row.q25, row.q75) == pytest.approx(tuple(np.quantile(scores, [0.5, 0.25, 0.75])))


def test_strip_keeps_inner_whitespace(spark):
    df = spark.createDataFrame([(" a  b \n", "\tc ")], "prediction string, reference string")
    assert tuple(scoring.strip_outputs(df).first()) == ("a  b", "c")


def test_summary_of_supplied_scores(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "score double")
    assert tuple(scoring.score_summary(df).first()) == (2.0, 1.0)
    assert tuple(scoring.score_summary(df.filter("false")).first()) == (0.0, 0.0)
