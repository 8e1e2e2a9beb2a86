"""Score distributions as mergeable rows: counts, moments, extremes and a quantile sketch.

One row per group and batch is stored as the batch comes; later the rows of any number of batches
are merged without a look at the scores again. Sums merge exactly, up to rounding; quartiles come
from sketches of a fixed size, whatever the number of scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch: at most some 3,000 scores are kept in it. The value returned for a
#: quantile p has a rank within ``RANK_ERROR`` of p; the expected error is a third of that. Groups of
#: no more than ``K`` scores are kept whole.
K, RANK_ERROR = 1000, 0.01
STATE = ("rows", "mean", "second", "low", "high", "sketch")


def score_sketches(rows: DataFrame, by: Sequence[str], score: str, k: int = K) -> DataFrame:
    """(by…, rows, mean, second, low, high, sketch) per group; ``second`` is the mean of the squares.

    Null scores and those that are no number are left out; a group without scores has no row. The
    sketches are filled before the shuffle, so a frequent group costs no more than its scan.
    """
    x = F.col(score).cast("double")
    kept = rows.select(*by, x.alias("x_")).filter("x_ is not null and not isnan(x_)")
    return kept.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.avg("x_").alias("mean"),
        F.avg(F.col("x_") * F.col("x_")).alias("second"),
        F.min("x_").alias("low"),
        F.max("x_").alias("high"),
        F.kll_sketch_agg_double("x_", F.lit(k)).alias("sketch"),
    )


def merge_sketches(stored: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """The rows of several batches as one row per group, in the same form, so they merge further."""
    weighted = lambda c: (F.sum(F.col("rows") * F.col(c)) / F.sum("rows")).alias(c)
    return stored.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        weighted("mean"),
        weighted("second"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"),
    )


def distribution(merged: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes and quartiles of every row of sketches."""
    variance = F.greatest(F.col("second") - F.col("mean") * F.col("mean"), F.lit(0.0))
    return merged.select(
        *[c for c in merged.columns if c not in STATE],
        "rows",
        "mean",
        F.sqrt(variance).alias("std"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        *[quantile(p).alias(n) for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))],
    )


def quantile(p: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(p))
