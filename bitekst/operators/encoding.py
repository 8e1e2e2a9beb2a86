"""Token ids from a supplied vocabulary table, and padding of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitekst.functions.scan import with_position
from bitekst.functions.text import words
from bitekst.session import broadcast_if_small

# Truncation length, id of unknown words, padding of ids and of labels.
MAX_TOKENS = 128
UNKNOWN_ID = 3
PAD_ID, PAD_LABEL = 1, -100


def encode_pairs(
    df: DataFrame,
    vocabulary: DataFrame,
    row_id: str = "pair_id",
    max_tokens: int = MAX_TOKENS,
    unknown: int = UNKNOWN_ID,
) -> DataFrame:
    """``input_ids``, ``attention_mask`` and ``labels`` of each pair, truncated, not padded.

    Both sides go through one look-up of vocabulary(word, id) and one grouping. With a vocabulary
    too large to broadcast, adaptive execution splits the partitions of frequent words: the
    vocabulary is a written table, so both sides of the join are exchanged.
    """
    sides = F.array(
        *[
            F.struct(F.lit(c).alias("side"), F.slice(words(F.col(c)), 1, max_tokens).alias("w"))
            for c in ("source", "target")
        ]
    )
    placed = df.select(row_id, F.inline(sides)).select(
        row_id, "side", F.posexplode_outer("w").alias("pos", "word")
    )
    looked_up = placed.join(broadcast_if_small(vocabulary), "word", "left")
    token = F.struct("pos", F.coalesce("id", F.lit(unknown)).alias("id"))

    def ids(side: str) -> Column:
        found = F.collect_list(F.when((F.col("side") == side) & F.col("word").isNotNull(), token))
        return F.transform(F.sort_array(found), lambda e: e["id"])

    grouped = looked_up.groupBy(row_id).agg(ids("source").alias("input_ids"), ids("target").alias("labels"))
    mask = F.transform("input_ids", lambda _: F.lit(1))
    return grouped.select(row_id, "input_ids", mask.alias("attention_mask"), "labels")


def pad_to(col: Column, size: Column, value: int) -> Column:
    return F.concat(col, F.array_repeat(F.lit(value), (size - F.size(col)).cast("int")))


def unpad(col: Column, value: int = PAD_LABEL) -> Column:
    """Undo label padding before scoring."""
    return F.filter(col, lambda x: x != value)


def pad_batches(
    encoded: DataFrame, batch_size: int, row_id: str = "pair_id"
) -> DataFrame:
    """Pad each batch of consecutive rows to its longest row."""
    placed = with_position(encoded, [F.col(row_id)])
    batch = Window.partitionBy("batch_id")
    return (
        placed.withColumn("batch_id", F.floor(F.col("position") / batch_size))
        .withColumns(
            {
                "longest": F.max(F.size("input_ids")).over(batch),
                "longest_label": F.max(F.size("labels")).over(batch),
            }
        )
        .select(
            row_id,
            "batch_id",
            pad_to(F.col("input_ids"), F.col("longest"), PAD_ID).alias("input_ids"),
            pad_to(F.col("attention_mask"), F.col("longest"), 0).alias("attention_mask"),
            pad_to(F.col("labels"), F.col("longest_label"), PAD_LABEL).alias("labels"),
        )
    )
