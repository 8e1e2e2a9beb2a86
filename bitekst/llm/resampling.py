"""Importance resampling of documents towards a target text, with exact ranks by a parallel sort.

Words are hashed into a fixed number of buckets. An array with one gain per bucket, the logarithm of
how much more frequent it is in the target than in the documents, scores a document by adding up the
gains of its words; Gumbel noise from a hash of the id makes the highest scores a draw without
replacement, in proportion to the importance weights.

Ranks come from sorting by regular sampling: every task sorts its rows (a run) and takes keys at
regular places of it; the keys of all runs give splitters; rows above the cut are exchanged by
segment, merged there, and a row's rank is its place in the segment behind the counts of the
segments before.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitekst.llm.common import by_batch, pick, stored

BUCKETS, LONGEST = 10_000, 1
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: Runs and segments at most, and places taken from a run (up to twice as many): what the driver gets
#: is their product, whatever the number of documents.
RUNS, SEGMENTS, REGULAR = 1024, 1024, 64
#: Rows of a segment, where the number of segments allows it.
SEGMENT_ROWS = 1 << 20

#: A-Z in lower case; every other ASCII character but digits and letters is a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def buckets(text: bytes | None, longest: int = LONGEST, size: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to ``longest`` words of a text, repeats included."""
    words = (text or b"").translate(_WORDS).split()
    runs = list(words)
    for n in range(2, longest + 1):
        runs += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % size


def bucket_counts(texts: DataFrame, longest: int = LONGEST, size: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; a task adds up its own and sends one array."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(buckets(text.as_py(), longest, size), minlength=size)
        (at,) = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(size, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What one word of a bucket adds to a weight, in thousandths of a natural logarithm."""
    size = float(len(corpus))
    ratio = (target + 1.0) * (corpus.sum() + size) / ((corpus + 1.0) * (target.sum() + size))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_features, weight) of every row."""

    def make():
        def run(b: dict) -> dict:
            found = [buckets(t, longest, len(gain)) for t in b["text"]]
            return {"doc_id": b["doc_id"], "n_features": [len(x) for x in found], "weight": [int(gain[x].sum()) for x in found]}

        return run

    texts = pick(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    return by_batch(texts, make, "doc_id long, n_features long, weight long")


def _key(score: int, doc_id: int | None, row: int) -> tuple:
    return -score, doc_id is None, doc_id or 0, row


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]


def splitters(rows: DataFrame, segments: int) -> list[tuple]:
    """The keys that part rows(score, doc_id, row) into segments of about equal size.

    Sorted runs give keys at regular places. A task does not know the length of its run beforehand:
    it takes every key first, and half of those it has whenever they are twice as many as wanted.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, every, seen = [], 1, 0
        for batch in batches:
            for i in range(-seen % every, batch.num_rows, every):
                if (seen + i) % every:
                    continue
                kept.append((seen + i, *(batch.column(c)[i].as_py() for c in range(3))))
                if len(kept) == 2 * REGULAR:
                    every *= 2
                    kept = [k for k in kept if k[0] % every == 0]
            seen += batch.num_rows
        columns = [pa.array([k[c] for k in kept], pa.int64()) for c in (1, 2, 3)]
        columns.append(pa.array([every] * len(kept), pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, ["score", "doc_id", "row", "stands_for"])

    runs = rows.select("score", "doc_id", "row").coalesce(RUNS).sortWithinPartitions(*_order())
    taken = runs.mapInArrow(sample, "score long, doc_id long, row long, stands_for long").collect()
    keys = sorted((_key(*r[:3]), r["stands_for"]) for r in taken)
    total, upto, out = sum(n for _, n in keys), 0, []
    for key, n in keys:
        if upto >= total * (len(out) + 1) / segments:
            out.append(key)
        upto += n
    return out


def ranked(rows: DataFrame, take: int, segments: int | None = None) -> DataFrame:
    """rows(score, doc_id, row, …) with ``rank``: 1, 2, 3, … for the ``take`` highest scores, ties to
    the smaller doc_id (null last), null for the others. ``row`` tells equal rows apart, so that any
    number of ties can be split; ``rows`` should be a stored table."""
    if segments is None:
        least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        segments = min(SEGMENTS, max(least, take // SEGMENT_ROWS))
    if take <= 0:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    split = splitters(rows, segments)

    def make():
        def run(b: dict) -> dict:
            keys = zip(b["score"], b["doc_id"], b["row"])
            return b | {"segment": [bisect.bisect_right(split, _key(*k)) for k in keys]}

        return run

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", segment int"
    parted = stored(by_batch(rows, make, schema), "segments")
    sizes = dict(parted.groupBy("segment").count().collect())
    before, offsets = 0, []
    for segment in range(len(split) + 1):
        offsets.append(before)
        before += sizes.get(segment, 0)
    # Segments that begin behind the cut stay where they are.
    last = bisect.bisect_left(offsets, take) - 1
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*_order()))
    rank = place + F.get(F.lit(offsets), F.col("segment"))
    top = parted.filter(F.col("segment") <= last).select("*", rank.cast("long").alias("rank"))
    top = top.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    rest = parted.filter(F.col("segment") > last).withColumn("rank", F.lit(None).cast("long"))
    return top.unionByName(rest).drop("segment")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least: int = LEAST_WORDS,
    seed: int = SEED,
    longest: int = LONGEST,
    size: int = BUCKETS,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null for rows
    that are not drawn.

    ``percent`` of the rows with at least ``least`` words (of runs, if ``longest`` is above 1) are
    drawn. A null or empty text has no words, weight 0, and is never drawn. Rows that share an id
    share the noise and are drawn one by one; a null id is hashed as an empty text and comes last
    among equal scores. Texts are read whole, whatever their length. Columns of other names are
    ignored. An empty ``docs`` gives no rows; with an empty ``target`` every word is equally likely.
    """
    gain = gains(bucket_counts(docs, longest, size), bucket_counts(target, longest, size))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(docs, gain, longest).withColumn("score", F.col("weight") + noise)
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    fit = scored.filter(F.col("n_features") >= least)
    drawn = ranked(fit, percent * fit.count() // 100)
    rest = scored.filter(F.col("n_features") < least).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn to look like the benchmark."""
    read = spark.read.parquet
    return resample(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet"))
