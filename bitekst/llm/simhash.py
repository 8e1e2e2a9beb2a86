"""Near-duplicate documents by SimHash, linked through pivot distance tables.

A fingerprint's Hamming distances to fixed reference fingerprints (pivots) form its row in the
distance table. By the triangle inequality two fingerprints within ``k`` bits differ by at most
``k`` in every coordinate, so a pair with a larger coordinate difference is discarded before the
bits are compared.

References of single bits give, for each group of references, the bits of one block. A pair within
three bits touches at most three of six groups, so its coordinates agree in some three: these
coordinates are the join key (20 combinations). Inside a key rows are ordered by their distance to
the first pivot and compared only as long as that coordinate allows; then all coordinates, then the
bits decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitekst.llm.common import ROW, by_batch, components, numbered, stored

SHINGLE, SEED, MAX_BITS = 3, 42, 3
BLOCKS = (11, 11, 11, 11, 10, 10)
PIVOTS = tuple(xxhash.xxh64_intdigest(bytes([i]), seed=7) for i in range(16))
#: Rows of one key that a task compares as they are; keys with more are split by pivot cells.
HEAVY = 4096
CELL, CELL_PIVOTS = 8, 5


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of unsigned 64-bit hashes as a signed number: bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        bits = np.unpackbits(h[i : i + 65536, None].view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, row, fp): the SimHash of every text as a signed 64-bit number; ``row`` numbers the
    rows of the scan.

    ASCII letters are lower-cased, words are split at ASCII white space. A bit is 1 if it is set in
    over half of the shingles' XXH64. A shorter text is one shingle; a text without words, empty or
    null, has fingerprint zero.
    """

    def make():
        digest = partial(xxhash.xxh64_intdigest, seed=seed)

        def one(text: bytes | None) -> int:
            w = text.lower().split() if text else []
            if not w:
                return 0
            parts = zip(*(w[i:] for i in range(shingle))) if len(w) >= shingle else [w]
            return fingerprint(np.fromiter(map(digest, map(b" ".join, parts)), np.uint64))

        return lambda b: b | {"fp": [one(t) for t in b["text"]]}

    texts = numbered(docs).select(
        docs["doc_id"].cast("long").alias("doc_id"), ROW, docs["text"].cast("binary").alias("text")
    )
    return by_batch(texts, make, f"doc_id long, {ROW} long, fp long").withColumnRenamed(ROW, "row")


def _masks() -> list[int]:
    ends = np.cumsum(BLOCKS).tolist()
    blocks = [((1 << n) - 1) << (end - n) for n, end in zip(BLOCKS, ends)]
    keep = len(BLOCKS) - MAX_BITS
    return [_signed(sum(c)) for c in combinations(blocks, keep)]


def _distance(i: int) -> Column:
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(PIVOTS[i])).cast("long")))


def _keyed(classes: DataFrame, heavy: int) -> DataFrame:
    """(key, d0, fp): a row for each combination of coordinate groups; keys with more than
    ``heavy`` rows get the cells of further pivots added. A row near the upper border of a cell goes
    to the next cell too, so that two rows within ``MAX_BITS`` meet in the higher of their cells."""
    keys = F.array(
        *[
            F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("long")))
            for t, m in enumerate(_masks())
        ]
    )
    rows = classes.select(F.explode(keys).alias("key"), _distance(0).cast("int").alias("d0"), "fp")
    full = stored(rows.groupBy("key").count().filter(F.col("count") > heavy).select("key"), "heavy")
    split = rows.join(full, "key", "left_semi")
    for i in range(1, CELL_PIVOTS + 1):
        at, cell = _distance(i), F.floor(_distance(i) / CELL)
        near = F.when(at % CELL >= CELL - MAX_BITS, F.array(cell, cell + 1)).otherwise(F.array(cell))
        split = split.withColumn("cell", F.explode(near)).select(
            F.xxhash64("key", "cell").alias("key"), "d0", "fp"
        )
    return rows.join(full, "key", "left_anti").unionByName(split)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, d0, fp) rows of a partition to a spanning forest of the links of each key."""
    pivots = np.array(PIVOTS, np.uint64)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        label = np.arange(n)
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, label[i], low)
            np.minimum.at(new, label[j], low)
            new = new[new]
            if (new == label).all():
                return label
            label = new

    def linked(key: np.ndarray, d0: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        table = np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)
        i, left, right, held = np.arange(len(fp)), [], [], 0
        for step in range(1, len(fp)):
            i = i[i < len(fp) - step]
            i = i[(key[i] == key[i + step]) & (d0[i + step] - d0[i] <= MAX_BITS)]
            if not len(i):
                break
            a, b = i, i + step
            close = np.abs(table[a] - table[b]).max(axis=1) <= MAX_BITS
            a, b = a[close], b[close]
            near = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
            left.append(a[near])
            right.append(b[near])
            held += int(near.sum())
            if held > 1 << 20:
                label = roots(len(fp), np.concatenate(left), np.concatenate(right))
                own = np.flatnonzero(label != np.arange(len(fp)))
                left, right, held = [own], [label[own]], 0
        if not left:
            return None
        label = roots(len(fp), np.concatenate(left), np.concatenate(right))
        own = np.flatnonzero(label != np.arange(len(fp)))
        signed = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([signed[own], signed[label[own]]], schema=schema)

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = (
            batch.column(0).to_numpy(),
            batch.column(1).to_numpy().astype(np.int64),
            batch.column(2).to_numpy().view(np.uint64),
        )
        held.append(cols)
        if held[0][0][0] != cols[0][-1]:  # a key has ended; the last one may go on
            whole = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1
            if (out := linked(*[c[:cut] for c in whole])) is not None:
                yield out
            held = [tuple(c[cut:] for c in whole)]
    if held and (out := linked(*[np.concatenate(c) for c in zip(*held)])) is not None:
        yield out


def links(classes: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(a, b): links of distinct fingerprints (column ``fp``) that join all those connected by
    steps of at most three bits; only a spanning forest of each key is returned."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _keyed(classes, heavy).repartition(n, "key").sortWithinPartitions("key", "d0", "fp")
    return dealt.mapInArrow(_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, row, fp, component_id, stays), one row per row of ``docs``.

    Documents are linked if their fingerprints differ in at most three bits; ``component_id`` is
    the smallest doc_id reachable over links. ``stays`` marks one row of each component: the first
    by doc_id (null last), then place. Rows with a null doc_id take part and do not name a component
    unless all of it is null. Repeated rows are copies like any other. Equal fingerprints are one
    class before anything is compared, so copies never meet each other. No rows give no rows.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    head = F.struct(F.isnull("doc_id").alias("null"), "doc_id", "row")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(head).alias("head")), "classes")
    label = components(links(classes, heavy))
    found = classes.join(label, classes["fp"] == label["node"], "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), "first", "head"
    )
    found = stored(found, "labelled")
    least = found.groupBy("label").agg(F.min("first").alias("component_id"), F.min("head").alias("head"))
    named = found.select("fp", "label").join(stored(least, "least"), "label")
    named = stored(named.select("fp", "component_id", F.col("head.row").alias("first_row")), "components")
    return marked.join(named, "fp").select(
        "doc_id", "row", "fp", "component_id", (F.col("row") == F.col("first_row")).alias("stays")
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of all documents."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select("doc_id", digits.alias("fingerprint"), "component_id")
