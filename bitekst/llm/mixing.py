"""Mixing of sources to target weights by balanced sampling (the cube method).

Every source has a target number of words. A document is taken a whole number of times: the whole part
of target / source size for certain, one time more with the fractional part as its inclusion
probability. Flight: probabilities move along directions that change neither the expected number of
words nor that of documents, until they are 0 or 1; a walk needs three open documents at a time, so it
runs over streams of any length. Documents walk in groups of one source and size class (powers of two),
dealt over many walks first; a walk leaves two open documents at most, which meet in fewer walks, and
at last in one for each class, which keeps a few more open. Landing: the few documents still open of a source are settled from the
largest to the smallest, each so that the words taken come nearest to the target.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitekst.functions.scan import ordered_chunks, running, with_position
from bitekst.llm.common import pick, stored
from bitekst.session import broadcast_if_small

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 11
#: Documents of a walk, on average, at the first level; walks that meet in one at the next.
WALK, MEET = 1024, 1024
#: Open documents of a source of which all choices are compared at the landing.
TRIED = 12
#: Documents of a class that stay open for the landing, besides those that the last walk leaves.
KEPT_OPEN = 4
#: Probabilities nearer to 0 or 1 than this are that.
NEAR = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) with the number of words of every row; a null text has none."""
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))
    return pick(docs, "doc_id", "source", "text").select("doc_id", "source", F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, no, source_size, docs, target) of rows(source, size).

    Sources in the order of their code points, null last, have the weights in turn. A target is at most
    ``most`` times the size; the others share what is left by weight. So all targets are the smaller of
    that bound and one multiple of the weight, which the sources in the order of size / weight give:
    the excess of those before, shared by those from here on, is largest where the bounds end.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    unknown = F.col("source").isNull()
    held = with_position(by_source, [unknown, F.col("source")], "no")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("no") % len(weights)).cast("int"))
    held = stored(held.withColumn("weight", weight.cast("double")), "sources")
    order = [F.col("source_size") / F.col("weight"), F.col("no")]
    sums = {"bounds": most * F.col("source_size").cast("double"), "weights": F.col("weight")}
    run = running(ordered_chunks(held, [], order), [], order, sums=sums, inclusive=False)
    whole = held.agg(F.sum("source_size").cast("double").alias("s"), F.sum("weight").alias("w"))
    share = run.agg(F.max((whole.select("s").scalar() - F.col("bounds")) / (whole.select("w").scalar() - F.col("weights")))).scalar()
    target = F.least(most * F.col("source_size").cast("double"), share * F.col("weight"))
    return held.select("source", "no", "source_size", "docs", target.alias("target"))


def step(units: list[list], flip: float, documents: bool = True) -> None:
    """Move the probabilities (first in each unit, size second) of two or three units so that one of
    them gets 0 or 1, the expected words (and documents, of three) unchanged. Which way is drawn with
    ``flip`` in [0, 1), so that every probability stays as it was on average."""
    sizes = [float(u[1]) for u in units]
    if len(units) == 3:
        a, b, c = sizes
        way = [b - c, c - a, a - b]
        if not any(way):
            way = [1.0, -1.0, 0.0]
    else:
        a, b = sizes
        way = [b, -a]
    ahead = min((1 - u[0] if w > 0 else u[0]) / abs(w) for u, w in zip(units, way) if w)
    behind = min((u[0] if w > 0 else 1 - u[0]) / abs(w) for u, w in zip(units, way) if w)
    move = ahead if flip * (ahead + behind) < behind else -behind
    for u, w in zip(units, way):
        p = u[0] + move * w
        u[0] = 0.0 if p < NEAR else 1.0 if p > 1 - NEAR else p


def walk(units: Iterator[list], draw: Callable[[], float]) -> Iterator[list]:
    """All units, decided (0 or 1) as soon as they are; at most two of different sizes stay open."""
    held: list[list] = []
    for unit in units:
        held.append(unit)
        while len(held) == 3 or len(held) == 2 and held[0][1] == held[1][1]:
            step(held, draw())
            yield from (u for u in held if u[0] in (0.0, 1.0))
            held = [u for u in held if u[0] not in (0.0, 1.0)]
    yield from held


def land(units: list[list]) -> list[list]:
    """Settle the open units of one source: from the largest on, each the way that brings the words
    taken nearest to what was expected; of the smallest ones the best of all choices."""
    units = sorted(units, key=lambda u: -u[1])
    off, last = 0.0, max(0, len(units) - TRIED)
    for u in units[:last]:
        p, size = u[0], u[1]
        u[0] = 1.0 if abs(off + (1 - p) * size) < abs(off - p * size) else 0.0
        off += (u[0] - p) * size
    choices = np.zeros(1)
    for u in units[last:]:
        choices = np.concatenate([choices - u[0] * u[1], choices + (1 - u[0]) * u[1]])
    best = int(np.abs(choices + off).argmin())
    for i, u in enumerate(units[last:]):
        u[0] = float(best >> i & 1)
    return units


def _grouped(rows: DataFrame, by: list[str], order: list, settle: Callable) -> DataFrame:
    """``settle(key, units)`` over the rows of every group as a stream; a unit is a list of p, size
    and the further columns."""
    names = ["p", "size", *[c for c in rows.columns if c not in ("p", "size")]]
    rows = rows.select(*names)
    keys = [names.index(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def stream():
            nonlocal schema
            for batch in batches:
                schema = schema or batch.schema
                yield from map(list, zip(*(c.to_pylist() for c in batch.columns)))

        rows_left = stream()
        ahead = next(rows_left, None)
        out = []

        def group(key):
            nonlocal ahead
            while ahead is not None and [ahead[k] for k in keys] == key:
                unit, ahead = ahead, next(rows_left, None)
                yield unit

        while ahead is not None:
            key = [ahead[k] for k in keys]
            for unit in settle(key, group(key)):
                out.append(unit)
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out.clear()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, rows.schema)


def cube_sample(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows(no, doc_id, size, p, …) with every p 0 or 1, balanced on words and documents within ``no``.

    The same rows give the same result: order and chance come from ids, sizes and the seed.
    """
    at = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    rows = stored(
        rows.select(
            "*",
            F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int").alias("class"),
            at.alias("at"),
        ),
        "probabilities",
    )
    is_open = (F.col("p") > 0) & (F.col("p") < 1)
    decided, rest = [rows.filter(~is_open)], rows.filter(is_open)

    def fly(key, units):
        return walk(units, random.Random(f"{seed}:{key}").random)

    def fly_last(key, units):
        yield from islice(units, KEPT_OPEN)
        yield from fly(key, units)

    walks = rows.count() // WALK
    while True:
        salted = rest.withColumn("salt", F.pmod("at", F.lit(max(1, walks))))
        flown = _grouped(salted, ["no", "class", "salt"], ["at", "doc_id"], fly if walks > 1 else fly_last)
        flown = stored(flown.select(*rows.columns), "flown")
        decided.append(flown.filter(~is_open))
        rest = flown.filter(is_open)
        if walks <= 1:
            break
        walks //= MEET
    decided.append(_grouped(rest, ["no"], ["class", "at", "doc_id"], lambda _, units: land(list(units))).select(*rows.columns))
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.drop("class", "at")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of ``docs``.

    ``taken`` is size times ``copies``, a whole number up to ``most``. A source's words come to its
    target but for about its smallest documents. Rows without words have no influence (taken
    0). A null source is a source of its own, the last. Rows that share an id, equal ones too, are
    sampled one by one. Columns of other names are ignored; an empty table gives no rows.
    """
    rows = stored(sized(docs), "sized")
    goals = stored(targets(rows, weights, most), "targets")
    goals = broadcast_if_small(goals.select(F.col("source").alias("_source"), "no", "source_size", "target"))
    times = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    met = rows.join(goals, rows["source"].eqNullSafe(F.col("_source"))).withColumn("times", times)
    base = F.floor(F.col("times") + NEAR)
    p = F.when(F.col("size") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("times") - F.col("base")))
    met = met.withColumn("base", base).withColumn("p", F.when(p < NEAR, 0.0).otherwise(p))
    done = cube_sample(met.select("no", "doc_id", "size", "source_size", "target", "base", "p"), seed)
    copies = (F.col("base") + F.col("p")).cast("long")
    return done.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights of 5, 2, 1 in turn."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
