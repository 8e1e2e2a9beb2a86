"""Exact quantiles of a large column.

The built-in exact ``percentile`` keeps every distinct value in one task. Here a histogram of
fixed size tells which bins hold the wanted ranks, and only those bins are looked at, with equal
values counted together first (a third of all scores may be exactly zero).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantiles(
    df: DataFrame, col: str, probs: list[float], low: float, high: float, bins: int = 65536
) -> Column:
    """Array of linearly interpolated quantiles as a scalar subquery; values lie in [low, high]."""
    scaled = (F.col(col) - F.lit(low)) / F.lit(high - low) * F.lit(bins)
    binned = df.select(
        F.col(col).alias("value"), F.least(F.floor(scaled), F.lit(bins - 1)).alias("bin")
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    histogram = (
        binned.groupBy("bin")
        .agg(F.count("*").alias("rows"))
        .select(
            "bin",
            "rows",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("skipped"),
            (F.sum("rows").over(everything) - 1).alias("last"),
        )
    )
    ranks = F.array(
        *[
            F.struct(
                F.lit(i).alias("prob"),
                F.lit(side).alias("side"),
                (F.floor if side == 0 else F.ceil)(F.lit(p) * F.col("last")).alias("rank"),
                (F.lit(p) * F.col("last")).alias("exact"),
            )
            for i, p in enumerate(probs)
            for side in (0, 1)
        ]
    )
    # Two rows per probability, whatever the size of the data.
    targets = (
        histogram.select("bin", "rows", "skipped", F.explode(ranks).alias("r"))
        .select("bin", "skipped", "rows", "r.*")
        .filter("rank >= skipped and rank < skipped + rows")
    )
    inside = binned.join(F.broadcast(targets.select("bin").distinct()), "bin", "left_semi")
    upto = Window.partitionBy("bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        inside.groupBy("bin", "value")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(upto))
    )
    picked = (
        counted.join(F.broadcast(targets), "bin")
        .filter("rank - skipped >= upto - n and rank - skipped < upto")
        .groupBy("prob")
        .agg(
            F.max(F.when(F.col("side") == 0, F.col("value"))).alias("a"),
            F.max(F.when(F.col("side") == 1, F.col("value"))).alias("b"),
            F.max(F.col("exact") - F.floor("exact")).alias("share"),
        )
        .withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * F.col("share"))
    )
    return picked.agg(
        F.array(*[F.max(F.when(F.col("prob") == i, F.col("q"))) for i in range(len(probs))])
    ).scalar()
