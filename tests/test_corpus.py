import hashlib
import math

import pytest
from pyspark.sql import functions as F

from bitekst.functions import text
from bitekst.functions.scan import with_position
from bitekst.operators import cleaning, corpus


def ids(spark, n):
    return spark.range(n).select(
        F.col("id").alias("pair_id"),
        F.concat(F.lit("s "), F.col("id")).alias("source"),
        F.concat(F.lit("t "), F.col("id")).alias("target"),
    )


def shuffled(n, seed=42):
    return sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


def collected(df, column="pair_id"):
    return sorted(r[column] for r in df.select(column).collect())


@pytest.mark.parametrize("size", [0, 1, 10, 499, 500, 501])
def test_subset_is_the_first_of_the_seeded_order(spark, size):
    df = ids(spark, 500)
    assert collected(corpus.subset(df, size)) == sorted(shuffled(500)[:size])
    assert collected(corpus.subset(df.repartition(3), size)) == collected(corpus.subset(df, size))


def test_coarse_buckets_give_the_same_subset(spark):
    from bitekst.functions.ranks import cut_keys, shuffle_key

    df = ids(spark, 500)
    for digits in (1, 2, 6):
        cut = cut_keys(df, "pair_id", 7, [lambda n: F.lit(123)], digits)
        got = df.filter(shuffle_key(7, F.col("pair_id")) <= cut[0])
        assert collected(got) == sorted(shuffled(500, 7)[:123])


def test_ladder_is_nested(spark):
    rows = corpus.nested_subsets(ids(spark, 300), (100, 200, 1000)).collect()
    by_size = {}
    for r in rows:
        by_size.setdefault(r.data_size, set()).add(r.pair_id)
    assert {k: len(v) for k, v in by_size.items()} == {100: 100, 200: 200, 300: 300}
    assert by_size[100] < by_size[200] < by_size[300]
    exact = corpus.nested_subsets(ids(spark, 200), (100, 200)).groupBy("data_size").count()
    assert {r.data_size: r["count"] for r in exact.collect()} == {100: 100, 200: 200}


@pytest.mark.parametrize("n", [1, 7, 101, 1000])
def test_split_counts(spark, n):
    rows = corpus.create_splits(ids(spark, n)).collect()
    counts = [sum(r.split == s for r in rows) for s in ("train", "val", "test")]
    assert tuple(counts) == corpus.split_sizes(n, 0.8, 0.1, 0.1)
    assert sum(counts) == n
    rest = math.ceil((1 - 0.8) * n)
    assert counts[0] == n - rest


def test_split_needs_whole_ratios(spark):
    with pytest.raises(ValueError):
        corpus.create_splits(ids(spark, 5), 0.8, 0.1, 0.2)


def test_hash_split_is_close(spark):
    rows = corpus.create_splits(ids(spark, 5000), exact=False).groupBy("split").count().collect()
    counts = {r.split: r["count"] for r in rows}
    assert abs(counts["train"] - 4000) < 150 and abs(counts["val"] - 500) < 100


def test_length_filter_is_inclusive(spark):
    rows = [(1, "a b c", "a b c"), (2, "a b", "a b c"), (3, "a b c", "a b c d"), (4, "a b c", "a b c d e")]
    df = spark.createDataFrame(rows, "pair_id long, source string, target string")
    assert collected(corpus.filter_by_length(df, 3, 4)) == [1, 3]


def test_duplicates_keep_the_first(spark):
    rows = [(5, "a b c", "x y z"), (2, "a b c", "x y z"), (3, "a b", "c x y z"), (4, "A b c", "x y z")]
    df = spark.createDataFrame(rows, "pair_id long, source string, target string")
    assert collected(corpus.drop_duplicate_pairs(df)) == [2, 3, 4]
    assert collected(corpus.preprocess_pairs(df, lowercase=True)) == [2]


def test_reverse_twice_is_identity(spark):
    df = ids(spark, 5)
    twice = corpus.reverse_pairs(corpus.reverse_pairs(df)).select(df.columns)
    assert sorted(twice.collect()) == sorted(df.collect())
    both = corpus.bidirectional(df)
    assert both.count() == 10
    assert {(r.src_lang, r.tgt_lang) for r in both.collect()} == {("nob_Latn", "eng_Latn")}


def test_directions(spark):
    rows = [(1, {"direction": "reverse"}), (2, {"direction": "forward"}), (3, {}), (4, None)]
    df = spark.createDataFrame(rows, "pair_id long, metadata map<string,string>")
    forward, backward = corpus.split_direction(df)
    assert collected(forward) == [2, 3, 4] and collected(backward) == [1]
    assert backward.first().src_lang == "eng_Latn"


def test_statistics(spark):
    rows = [(1, "a b c", "a"), (2, "a", "")]
    df = spark.createDataFrame(rows, "pair_id long, source string, target string")
    assert tuple(corpus.corpus_stats(df).first()) == (2, 2.0, 0.5, 3, 1, 1, 0)
    empty = corpus.corpus_stats(df.filter("false")).first()
    assert tuple(empty)[:3] == (0, 0.0, 0.0)


def test_mixed_corpora_keep_ids_apart(spark):
    mixed = corpus.mix_corpora({"a": ids(spark, 3), "b": ids(spark, 4)}, min_words=1)
    assert collected(mixed) == ["a:0", "a:1", "a:2", "b:3"]


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k")).repartition(7)
    rows = with_position(df, [F.col("k")]).collect()
    assert all(r.position * 3 == r.k for r in rows) and len(rows) == 1000


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


@pytest.mark.parametrize(
    "raw, count",
    [("", 0), ("   ", 0), (" a b c\n", 3), ("a\x1fb", 2), ("one", 1)],
)
def test_words(spark, raw, count):
    assert one(spark, raw, text.word_count(F.col("t"))) == count == len(raw.split())
    assert one(spark, raw, text.words(F.col("t"))) == raw.split()


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Title\nTitle and more\nrest", "Title and more\nrest"),
        (" Title \n Title\nrest\n", " Title\nrest"),
        ("Title\nOther\nrest", "Title\nOther\nrest"),
        ("\n\nTitle", "\n\nTitle"),
        ("Title\n\nTitle", "Title\n\nTitle"),
        ("single", "single"),
        ("", ""),
    ],
)
def test_title(spark, raw, want):
    assert one(spark, raw, cleaning.drop_dup_title(F.col("t"))) == want


def test_sentences(spark):
    raw = 'Dr. Hansen came home. He said "go away!" Then  he left. no. A b\nThis is the end'
    got = one(spark, raw, cleaning.split_sentences(F.col("t"), "en"))
    assert got == [
        "Dr. Hansen came home.",
        'He said "go away!"',
        "Then he left. no.",
        "This is the end",
    ]


def plain_merge(sentences, min_words):
    merged, held = [], ""
    for s in sentences:
        if len((held + " " + s).split()) < min_words:
            held = (held + " " + s).strip()
        else:
            merged += [held] if held else []
            held = s
    return merged + ([held] if held else [])


@pytest.mark.parametrize("min_words", [5, 8, 10])
def test_merge(spark, min_words):
    cases = [[], ["a b c"], ["a b c", "d e f", "g h i", "a b c d e f g h i j k", "x y z"], ["a b c d"] * 7]
    for case in cases:
        df = spark.createDataFrame([(case,)], "s array<string>")
        got = df.select(cleaning.merge_short(F.col("s"), min_words)).first()[0]
        assert got == plain_merge(case, min_words)


def test_short_merge_limit_changes_nothing(spark):
    case = ["a b c", "d e f", "g h i j"]
    df = spark.createDataFrame([(case,)], "s array<string>")
    assert df.select(cleaning.merge_short(F.col("s"))).first()[0] == case


def test_subset_of_both_directions(spark):
    both = corpus.bidirectional(ids(spark, 100))
    rows = both.collect()
    assert len({r.pair_id for r in rows}) == 200
    assert sorted(r.base_id for r in rows) == sorted([*range(100)] * 2)
    assert corpus.subset(both, 51).count() == 51
    named = ids(spark, 3).withColumn("pair_id", F.concat(F.lit("p"), "pair_id"))
    assert collected(corpus.bidirectional(named)) == sorted(
        f"p{i}:{d}" for i in range(3) for d in ("forward", "reverse")
    )


def test_seed_grid_is_one_subset_per_seed(spark):
    df = ids(spark, 400)
    rows = corpus.seed_grid(df, 30, (1, 2, 42)).collect()
    for seed in (1, 2, 42):
        got = sorted(r.pair_id for r in rows if r.seed == seed)
        assert got == sorted(shuffled(400, seed)[:30])
    assert corpus.seed_grid(df, 1000, (1, 2)).count() == 800


def test_line_break_behind_an_abbreviation_ends_the_sentence(spark):
    raw = "See the list of No.\nThe next line begins here now."
    got = one(spark, raw, cleaning.split_sentences(F.col("t"), "en"))
    assert got == ["See the list of No.", "The next line begins here now."]
    same = one(spark, "It was No. Seven of the list.", cleaning.split_sentences(F.col("t"), "en"))
    assert same == ["It was No. Seven of the list."]


def test_merge_of_many_sentences(spark):
    case = [f"a{i} b c" for i in range(30000)]
    df = spark.createDataFrame([(case,)], "s array<string>")
    assert df.select(cleaning.merge_short(F.col("s"), 8)).first()[0] == plain_merge(case, 8)
