"""Pair-level corpus operators: filters, subsets, splits, directions, statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from bitekst.functions.ranks import cut_keys, shuffle_key
from bitekst.functions.text import word_count
from bitekst.session import broadcast_if_small, materialize

# Length limits, seed, repeat seeds, size ladder and language codes.
MIN_WORDS, MAX_WORDS = 3, 512
SEED = 42
REPEAT_SEEDS = (42, 123, 456)
SIZE_LADDER = (100, 500, 1000, 2000, 4000, 6000, 8000, 10000)
FORWARD_SOURCE, FORWARD_TARGET = "nob_Latn", "eng_Latn"


def filter_by_length(
    df: DataFrame, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS
) -> DataFrame:
    # A filter evaluates each mention of an expression anew, also of a column defined before it.
    # Taking the counts out of a one-element array makes them real columns: one split per text.
    counts = F.struct(*[word_count(F.col(c)).alias(c) for c in ("source", "target")])
    counted = df.select("*", F.inline(F.array(counts)).alias("_source_words", "_target_words"))
    fits = [F.col(f"_{c}_words").between(min_words, max_words) for c in ("source", "target")]
    return counted.filter(fits[0] & fits[1]).select(df.columns)


def drop_duplicate_pairs(df: DataFrame, row_id: str = "pair_id") -> DataFrame:
    """Keep the first of equal (source, target) pairs."""
    return _without_later_copies(df, df, row_id)


def _without_later_copies(df: DataFrame, texts: DataFrame, row_id: str) -> DataFrame:
    """``df`` without the rows whose pair stands in ``texts`` under a smaller id.

    Copies are recognised by a 256-bit digest: only ids and digests are shuffled, a group of copies
    shrinks to one line per task before the exchange, and what is then taken off are the ids of the
    later copies alone. So rows stay where they are as long as these ids fit a broadcast.
    """
    digest = F.sha2(F.to_json(F.struct("source", "target")), 256)
    marked = materialize(texts.select(row_id, digest.alias("digest")))
    first = marked.groupBy("digest").agg(F.min(row_id).alias("first"), F.count("*").alias("n"))
    again = materialize(first.filter("n > 1").select("digest", "first"))
    later = marked.join(again, "digest").filter(F.col(row_id) > F.col("first")).select(row_id)
    return df.join(broadcast_if_small(later), row_id, "left_anti")


def preprocess_pairs(
    df: DataFrame,
    row_id: str = "pair_id",
    min_words: int = MIN_WORDS,
    max_words: int = MAX_WORDS,
    remove_duplicates: bool = True,
    lowercase: bool = False,
) -> DataFrame:
    """Length filter, optional lower case, first of equal pairs.

    Copies have equal lengths, so they are looked for before the filter, which is evaluated once.
    """
    out = filter_by_length(df, min_words, max_words)
    low = {c: F.lower(c) for c in ("source", "target")} if lowercase else {}
    out = out.withColumns(low) if low else out
    if not remove_duplicates:
        return out
    return _without_later_copies(out, df.withColumns(low) if low else df, row_id)


def mix_corpora(corpora: dict[str, DataFrame], row_id: str = "pair_id", **options) -> DataFrame:
    """Union of named corpora with a ``corpus`` column and ids that stay unique, pre-processed."""
    out = None
    for name, df in corpora.items():
        marked = df.withColumn("corpus", F.lit(name)).withColumn(
            row_id, F.concat_ws(":", F.lit(name), F.col(row_id))
        )
        out = marked if out is None else out.unionByName(marked)
    return preprocess_pairs(out, row_id, **options)


def subset(df: DataFrame, size: int | Column, seed: int = SEED, row_id="pair_id") -> DataFrame:
    """``size`` rows without replacement, all rows if there are not more; same rows every time."""
    size = size if isinstance(size, Column) else F.lit(size)
    cut = cut_keys(df, row_id, seed, [lambda total: F.least(size, total)])
    return df.filter(shuffle_key(seed, F.col(row_id)) <= cut[0])


def nested_subsets(
    df: DataFrame, sizes: tuple[int, ...] = SIZE_LADDER, seed: int = SEED, row_id="pair_id"
) -> DataFrame:
    """All rungs of the size ladder in one pass: one output row per row and rung it belongs to.

    Rungs above the table size are left out and the full table is the last rung.
    """
    cuts = cut_keys(
        df, row_id, seed, [lambda total, s=s: F.least(F.lit(s), total) for s in sizes]
    )
    total = df.agg(F.count("*")).scalar()
    keyed = df.withColumns({"_key": shuffle_key(seed, F.col(row_id)), "_cuts": cuts, "_all": total})
    rungs = [
        F.when((F.col("_all") >= s) & (F.col("_key") <= F.col("_cuts")[i]), F.lit(s).cast("long"))
        for i, s in enumerate(sizes)
    ]
    member = F.array_distinct(F.array_compact(F.array(*rungs, F.col("_all"))))
    return keyed.select(*df.columns, F.explode(member).alias("data_size"))


def split_sizes(total: int, train: float, val: float, test: float) -> tuple[int, int, int]:
    """Row counts of a two-step split: the part cut off is rounded up each time."""
    rest = math.ceil((1 - train) * total)
    tail = math.ceil((1 - val / (val + test)) * rest)
    return total - rest, rest - tail, tail


def create_splits(
    df: DataFrame,
    train: float = 0.8,
    val: float = 0.1,
    test: float = 0.1,
    seed: int = SEED,
    row_id="pair_id",
    exact: bool = True,
) -> DataFrame:
    """Add ``split``: train, val or test.

    ``exact`` gives the exact counts; otherwise the key itself is compared with the ratios, which
    needs no pass over the data and gives the ratios up to chance.
    """
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("ratios must sum to 1")
    key = shuffle_key(seed, F.col(row_id))
    if not exact:
        place = F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
        cut_train, cut_val = place < train, place < train + val
    else:
        share = 1 - val / (val + test)

        def rest(total: Column) -> Column:
            return F.ceil(F.lit(1 - train) * total)

        cuts = cut_keys(
            df,
            row_id,
            seed,
            [
                lambda total: total - rest(total),
                lambda total: total - F.ceil(F.lit(share) * rest(total)),
            ],
        )
        cut_train, cut_val = key <= cuts[0], key <= cuts[1]
    return df.withColumn(
        "split", F.when(cut_train, "train").when(cut_val, "val").otherwise("test")
    )


def seed_grid(
    df: DataFrame, size: int, seeds: tuple[int, ...] = REPEAT_SEEDS, row_id="pair_id"
) -> DataFrame:
    """One subset per seed, marked with its seed; all seeds in one pass."""
    cuts = cut_keys(df, row_id, list(seeds), [lambda total: F.least(F.lit(size), total)] * len(seeds))
    keyed = df.withColumn("_cuts", cuts)
    member = [
        F.when(shuffle_key(s, F.col(row_id)) <= F.col("_cuts")[i], F.lit(s)) for i, s in enumerate(seeds)
    ]
    return keyed.select(*df.columns, F.explode(F.array_compact(F.array(*member))).alias("seed"))


def reverse_pairs(
    df: DataFrame, source_lang: str = FORWARD_SOURCE, target_lang: str = FORWARD_TARGET
) -> DataFrame:
    """Swap the sides and the language codes; other columns stay."""
    rest = [c for c in df.columns if c not in ("source", "target", "src_lang", "tgt_lang")]
    return df.select(
        *rest,
        F.col("target").alias("source"),
        F.col("source").alias("target"),
        F.lit(target_lang).alias("src_lang"),
        F.lit(source_lang).alias("tgt_lang"),
    )


def bidirectional(
    df: DataFrame,
    source_lang: str = FORWARD_SOURCE,
    target_lang: str = FORWARD_TARGET,
    row_id: str = "pair_id",
) -> DataFrame:
    """Forward and reversed rows. Both carry the forward codes; ``direction`` tells them apart.

    ``row_id`` is made unique again (doubled, and one more for the reversed row; a text gets a
    suffix); ``base_id`` is the id that both rows come from.
    """
    codes = {"src_lang": F.lit(source_lang), "tgt_lang": F.lit(target_lang)}
    forward = df.withColumns({**codes, "direction": F.lit("forward")})
    backward = reverse_pairs(df).withColumns({**codes, "direction": F.lit("reverse")})
    both = forward.unionByName(backward).withColumn("base_id", F.col(row_id))
    is_back = F.col("direction") == "reverse"
    if isinstance(df.schema[row_id].dataType, IntegralType):
        unique = F.col("base_id").cast("long") * 2 + is_back.cast("int")
    else:
        unique = F.concat_ws(":", "base_id", "direction")
    return both.withColumn(row_id, unique)


def split_direction(
    df: DataFrame, source_lang: str = FORWARD_SOURCE, target_lang: str = FORWARD_TARGET
) -> tuple[DataFrame, DataFrame]:
    """Rows marked ``direction = reverse`` in their metadata, and all others, as (others, marked)."""
    marked = F.coalesce(F.col("metadata")["direction"], F.lit("")) == "reverse"
    forward = df.filter(~marked).withColumns(
        {"src_lang": F.lit(source_lang), "tgt_lang": F.lit(target_lang)}
    )
    backward = df.filter(marked).withColumns(
        {"src_lang": F.lit(target_lang), "tgt_lang": F.lit(source_lang)}
    )
    return forward, backward


def preview(df: DataFrame, n: int = 3, width: int = 100, row_id="pair_id") -> DataFrame:
    """The first ``n`` rows with shortened texts."""
    short = [F.substring(c, 1, width).alias(c) for c in ("source", "target")]
    return df.orderBy(row_id).limit(n).select(row_id, *short)


def _length_aggregates() -> list[Column]:
    src, tgt = word_count(F.col("source")), word_count(F.col("target"))
    return [
        F.count("*").alias("total"),
        F.coalesce(F.avg(src), F.lit(0.0)).alias("avg_source_length"),
        F.coalesce(F.avg(tgt), F.lit(0.0)).alias("avg_target_length"),
        F.max(src).alias("max_source_length"),
        F.max(tgt).alias("max_target_length"),
        F.min(src).alias("min_source_length"),
        F.min(tgt).alias("min_target_length"),
    ]


def corpus_stats(df: DataFrame) -> DataFrame:
    return df.agg(*_length_aggregates())


def split_stats(df: DataFrame, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(*_length_aggregates())
