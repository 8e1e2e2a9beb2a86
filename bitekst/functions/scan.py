"""Running values over an ordered table, also when one key holds most of the rows.

A window would send a whole key to one task. Here the rows are range-partitioned by key and order,
each range is one chunk, and a running value is the value of the chunks before (one row per key and
chunk) combined with a window inside the chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitekst.session import materialize, partitions_for

CHUNK = "_chunk"


def ordered_chunks(
    df: DataFrame, by: list[str], order: list[Column], chunks: int | None = None
) -> DataFrame:
    """Add the chunk number. ``order`` must be total within ``by``, so that ties can be split.

    The result is checkpointed: range bounds come from a sample, and every later use of the chunk
    number has to see the same bounds. The number of chunks follows the measured size of the input,
    which is written down first, as finding the bounds reads it too.
    """
    if chunks is None:
        df = materialize(df)
        chunks = partitions_for(df)
    ranged = df.repartitionByRange(chunks, *by, *order)
    return materialize(ranged.withColumn(CHUNK, F.spark_partition_id()))


def running(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    maxima: dict[str, Column] | None = None,
    sums: dict[str, Column] | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running maxima and sums to a table made by :func:`ordered_chunks`."""
    maxima, sums = maxima or {}, sums or {}
    values = {**maxima, **sums}
    fold = {name: (F.max if name in maxima else F.sum) for name in values}
    state = df.groupBy(*by, CHUNK).agg(*[fold[n](c).alias(f"_s_{n}") for n, c in values.items()])
    earlier = (
        Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    prefix = state.select(
        *by, CHUNK, *[fold[n](f"_s_{n}").over(earlier).alias(f"_p_{n}") for n in values]
    )
    local = (
        Window.partitionBy(*by, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    out = df.select("*", *[fold[n](c).over(local).alias(f"_l_{n}") for n, c in values.items()])
    out = out.join(prefix, [*by, CHUNK])
    combined = [
        F.greatest(f"_l_{n}", f"_p_{n}").alias(n)
        if n in maxima
        else (F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_p_{n}", F.lit(0))).alias(n)
        for n in values
    ]
    return out.select(*df.columns, *combined)


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Dense 0-based position of every row in the whole table."""
    chunked = ordered_chunks(df, [], order)
    return running(chunked, [], order, sums={name: F.lit(1)}, inclusive=False).drop(CHUNK)
