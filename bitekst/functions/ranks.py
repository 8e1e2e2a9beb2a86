"""Seeded, reproducible order of rows without sorting the rows.

Every row gets the key ``md5(seed:id)``. "The first k rows of the shuffled table" is then "all
rows whose key is at most the k-th smallest key", and that key is found from a table of bucket
counts of fixed size plus the rows of the one bucket it falls in. The table itself is only
filtered; nothing but ids is ever shuffled. ``id`` must be unique.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Below and above every hexadecimal key.
BEFORE_ALL = ""
AFTER_ALL = "~"


def shuffle_key(seed: int | Column, row_id: Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat(seed.cast("string"), F.lit(":"), row_id.cast("string")))


def cut_keys(
    df: DataFrame,
    row_id: str,
    seed: int | list[int],
    cuts: list[Callable[[Column], Column]],
    digits: int = 4,
) -> Column:
    """Array with, for each cut, the key of the last row inside it (a scalar subquery).

    ``cuts`` maps the number of rows to a number of rows. ``seed`` is one seed for all cuts or a
    list with one for each; all seeds are served by the same passes. The bucket table has at most
    ``16 ** digits`` rows per seed whatever the size of ``df``.
    """
    seeds = [seed] * len(cuts) if isinstance(seed, int) else list(seed)
    orders = list(dict.fromkeys(seeds))
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("order"), shuffle_key(s, F.col(row_id)).alias("key"))
            for i, s in enumerate(orders)
        ]
    )
    keyed = df.select(F.inline(keys)).withColumn("bucket", F.substring("key", 1, digits))
    whole = Window.partitionBy("order")
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        keyed.groupBy("order", "bucket")
        .agg(F.count("*").alias("rows"))
        .select(
            "order",
            "bucket",
            "rows",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("skipped"),
            F.sum("rows").over(everything).alias("total"),
        )
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(i).alias("cut"),
                F.lit(orders.index(s)).alias("of"),
                c(F.col("total")).cast("long").alias("k"),
            )
            for i, (s, c) in enumerate(zip(seeds, cuts))
        ]
    )
    targets = (
        buckets.select("*", F.explode(wanted).alias("w"))
        .select("order", "bucket", "rows", "skipped", "total", "w.cut", "w.of", "w.k")
        .filter(F.col("order") == F.col("of"))
    )
    inside = targets.filter("k > 0 and k < total and k > skipped and k <= skipped + rows")
    # One row per cut at most, so this side always fits a broadcast.
    position = F.row_number().over(Window.partitionBy("cut").orderBy("key"))
    found = (
        keyed.join(F.broadcast(inside.select("order", "bucket", "cut", "k", "skipped")), ["order", "bucket"])
        .withColumn("position", position + F.col("skipped"))
        .filter("position = k")
        .select("cut", "key")
    )
    edges = (
        targets.filter("skipped = 0 and (k <= 0 or k >= total)")
        .select("cut", F.when(F.col("k") <= 0, BEFORE_ALL).otherwise(AFTER_ALL).alias("key"))
    )
    row = found.unionByName(edges).agg(
        F.array(*[F.max(F.when(F.col("cut") == i, F.col("key"))) for i in range(len(cuts))])
    )
    return row.scalar()
