"""Document pairs to sentence pairs, from supplied sentence vectors.

Input everywhere: ``sentences(doc_id, side, pos, sent, v)`` with side ``en`` or ``no``, 0-based
``pos`` and a vector per sentence. ``sent`` may be left out where texts are not wanted; the aligned
pairs then have positions only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitekst.functions.scan import ordered_chunks, running
from bitekst.functions.vectors import cosine
from bitekst.session import broadcast_if_small, materialize

# Lowest similarity of an aligned pair, and the count difference up to which
# sentences are paired by position.
THRESHOLD = 0.75
SEQUENTIAL_GAP = 1

# Sentences per side of one block of the similarity matrix.
BLOCK = 256

_BEST = (
    "doc_id long, side string, pos long, other long, similarity double, gap long, "
    "total double, cells long"
)


def side_counts(sentences: DataFrame) -> DataFrame:
    """(doc_id, en_sentences, no_sentences)."""
    return sentences.groupBy("doc_id").agg(
        F.count_if(F.col("side") == "en").alias("en_sentences"),
        F.count_if(F.col("side") == "no").alias("no_sentences"),
    )


def of_side(sentences: DataFrame, side: str, pos: str, vector: str | None = None) -> DataFrame:
    """The sentences of a side with the side's names: position, text (if there is one), vector."""
    columns = [F.col("pos").alias(pos)]
    if texts(sentences):
        columns.append(F.col("sent").alias(side))
    if vector:
        columns.append(F.col("v").alias(vector))
    return sentences.filter(F.col("side") == side).select("doc_id", *columns)


def texts(sentences: DataFrame) -> list[str]:
    """The text columns that aligned pairs have."""
    return ["en", "no"] if "sent" in sentences.columns else []


def align_sequential(sentences: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pair equal positions; joined on document and position, so one long document spreads out."""
    en, no = of_side(sentences, "en", "pos", "a"), of_side(sentences, "no", "pos", "b")
    return (
        en.join(no, ["doc_id", "pos"])
        .withColumn("similarity", cosine(F.col("a"), F.col("b")))
        .filter(F.col("similarity") >= threshold)
        .select(
            "doc_id",
            F.col("pos").alias("en_pos"),
            F.col("pos").alias("no_pos"),
            *texts(sentences),
            "similarity",
            F.lit("sequential").alias("method"),
        )
    )


def _block_best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best partner inside one block, for each of its sentences on both sides."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            en, no = (
                np.asarray(v, dtype=float).reshape(len(pos), -1)
                for v, pos in ((row.en_v, row.en_pos), (row.no_v, row.no_pos))
            )
            lengths = [np.linalg.norm(v, axis=1, keepdims=True) for v in (en, no)]
            en, no = (v / np.where(n > 0, n, 1.0) for v, n in zip((en, no), lengths))
            cells = np.round(en @ no.T, 12)
            gaps = np.abs(np.subtract.outer(row.en_copy, row.no_copy))
            for side, m, gap, own, partner in (
                ("en", cells, gaps, row.en_pos, row.no_pos),
                ("no", cells.T, gaps.T, row.no_pos, row.en_pos),
            ):
                top = m.max(axis=1)
                tied = np.where(m == top[:, None], gap, np.iinfo(np.int64).max)
                pick = tied.argmin(axis=1)  # positions ascend, so the first is the lowest
                yield pd.DataFrame(
                    {
                        "doc_id": row.doc_id,
                        "side": side,
                        "pos": own,
                        "other": np.asarray(partner)[pick],
                        "similarity": top,
                        "gap": tied[np.arange(len(own)), pick],
                        "total": m.sum(axis=1),
                        "cells": m.shape[1],
                    }
                )


def with_copies(sentences: DataFrame) -> DataFrame:
    """(doc_id, side, pos, v, copy): equal vectors of a document and side numbered in order of
    position.

    Digests are numbered, not vectors; a hash is enough to tell vectors apart: a collision changes
    a preference between equals, never a similarity.
    """
    keys, order = ["doc_id", "side", "digest"], [F.col("pos")]
    hashed = sentences.select("doc_id", "side", "pos", F.xxhash64("v").alias("digest"))
    numbered = running(
        ordered_chunks(hashed, keys, order), keys, order, sums={"copy": F.lit(1).cast("long")}
    ).select("doc_id", "side", "pos", "copy")
    return sentences.select("doc_id", "side", "pos", "v").join(numbered, ["doc_id", "side", "pos"])


def best_partners(sentences: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each sentence its most similar sentence on the other side of the document.

    The matrix of a document is cut into blocks, and every pair of blocks is a key of its own: the
    blocks of a long document spread over the tasks, each holds one pair at a time and gives back
    one line per sentence of the pair, never the cells. Equal similarity prefers the same copy
    number among equal vectors, then the lowest position. Also returned: sum and number of the
    sentence's cells.
    """
    if "copy" not in sentences.columns:
        sentences = with_copies(sentences)
    blocks = (
        sentences.groupBy("doc_id", "side", F.floor(F.col("pos") / block).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "copy", "v"))).alias("s"))
        .select("doc_id", "side", "block", "s.pos", "s.copy", F.flatten("s.v").alias("v"))
    )
    # the numbers of the blocks that the other side of the document has
    place = sentences.select("doc_id", "side", F.floor(F.col("pos") / block).alias("block")).distinct()
    partners = place.groupBy("doc_id", "side").agg(F.collect_list("block").alias("partners"))
    other = F.when(F.col("side") == "en", "no").otherwise("en").alias("side")
    facing = blocks.join(partners.select("doc_id", other, "partners"), ["doc_id", "side"])

    def one_side(side: str, opposite: str) -> DataFrame:
        renamed = [F.col(c).alias(f"{side}_{c}") for c in ("pos", "copy", "v")]
        return facing.filter(F.col("side") == side).select(
            "doc_id", F.col("block").alias(f"{side}_block"), F.explode("partners").alias(f"{opposite}_block"), *renamed
        )

    pairs = one_side("en", "no").join(one_side("no", "en"), ["doc_id", "en_block", "no_block"])
    best = pairs.drop("en_block", "no_block").mapInPandas(_block_best, _BEST)
    rank = F.struct(F.col("similarity"), -F.col("gap"), -F.col("other"))
    return (
        best.groupBy("doc_id", "side", "pos")
        .agg(
            F.max(rank).alias("r"),
            F.sum("total").alias("total"),
            F.sum("cells").alias("cells"),
        )
        .select(
            "doc_id",
            "side",
            "pos",
            (-F.col("r.col3")).alias("other"),
            F.col("r.similarity").alias("similarity"),
            "total",
            "cells",
        )
    )


def doc_cosine(sentences: DataFrame) -> DataFrame:
    """Row summary of each document's matrix: best partner, its cosine, and the mean cosine."""
    return (
        best_partners(sentences)
        .filter("side = 'en'")
        .select(
            "doc_id",
            F.col("pos").alias("en_pos"),
            F.col("other").alias("no_pos"),
            "similarity",
            (F.col("total") / F.col("cells")).alias("mean_similarity"),
            "cells",
        )
    )


def mutual_pairs(sentences: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, en_pos, no_pos, similarity): pairs that are each other's best, from threshold up."""
    return _mutual(best_partners(sentences), threshold)


def _mutual(best: DataFrame, threshold: float) -> DataFrame:
    """A pair is mutual when both of its sides name it, so counting names replaces a self-join."""
    is_en = F.col("side") == "en"
    named = best.filter(F.col("similarity") >= threshold).select(
        "doc_id",
        F.when(is_en, F.col("pos")).otherwise(F.col("other")).alias("en_pos"),
        F.when(is_en, F.col("other")).otherwise(F.col("pos")).alias("no_pos"),
        "similarity",
    )
    return (
        named.groupBy("doc_id", "en_pos", "no_pos")
        .agg(F.count("*").alias("names"), F.max("similarity").alias("similarity"))
        .filter("names = 2")
        .drop("names")
    )


def align_one_to_one(
    sentences: DataFrame, threshold: float = THRESHOLD, rounds: int | None = None
) -> DataFrame:
    """Repeated mutual-best matching until no pair reaches the threshold.

    Each round is checkpointed. The number of rounds follows the data; ``rounds`` can stop it
    early, e.g. after the first. A sentence whose best partner is below the threshold leaves for
    good, since partners only become fewer; so do documents with nothing left on one side.
    """
    # copy numbers are given once and kept
    left, matched, done = materialize(with_copies(sentences)), None, 0
    while rounds is None or done < rounds:
        best = materialize(best_partners(left).select("doc_id", "side", "pos", "other", "similarity"))
        found = materialize(_mutual(best, threshold))
        matched = found if matched is None else matched.unionByName(found)
        if found.isEmpty():
            break
        used = found.select("doc_id", F.lit("en").alias("side"), F.col("en_pos").alias("pos"))
        used = used.unionByName(
            found.select("doc_id", F.lit("no").alias("side"), F.col("no_pos").alias("pos"))
        )
        open_ = best.filter(F.col("similarity") >= threshold).select("doc_id", "side", "pos")
        open_ = open_.join(used, ["doc_id", "side", "pos"], "left_anti")
        left = materialize(left.join(open_, ["doc_id", "side", "pos"], "left_semi"))
        done += 1
        if left.isEmpty():
            break
    if matched is None:
        matched = _mutual(best_partners(left), threshold).limit(0)
    if texts(sentences):
        matched = matched.join(of_side(sentences, "en", "en_pos"), ["doc_id", "en_pos"])
        matched = matched.join(of_side(sentences, "no", "no_pos"), ["doc_id", "no_pos"])
    return matched.select(
        "doc_id", "en_pos", "no_pos", *texts(sentences), "similarity", F.lit("mutual").alias("method")
    )


def _branches(sentences: DataFrame) -> DataFrame:
    """(doc_id, close): documents with both sides, and whether they are paired by position."""
    close = F.abs(F.col("en_sentences") - F.col("no_sentences")) <= SEQUENTIAL_GAP
    both = F.least("en_sentences", "no_sentences") > 0
    return side_counts(sentences).filter(both).select("doc_id", close.alias("close"))


def split_branches(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sentences of documents paired by position, and of those that need matching."""
    marked = sentences.join(_branches(sentences), "doc_id")
    columns = sentences.columns
    return marked.filter("close").select(columns), marked.filter("not close").select(columns)


def align_documents(
    sentences: DataFrame,
    threshold: float = THRESHOLD,
    match: Callable[[DataFrame, float], DataFrame] = align_one_to_one,
) -> DataFrame:
    """All documents: by position when the sentence counts are close, else by ``match``: mutual best,
    or :func:`bitekst.operators.assignment.align_assignment`.

    Vectors move once, to be paired; which documents a pair or a sentence counts for is asked by the
    numbers of the documents alone. Positions of the other documents are paired in vain for that, at
    most one a sentence.
    """
    branches = broadcast_if_small(_branches(sentences))
    close, other = (branches.filter(c).select("doc_id") for c in ("close", "not close"))
    aligned = align_sequential(sentences, threshold).join(close, "doc_id", "left_semi")
    if other.isEmpty():
        return aligned
    unmatched = sentences.join(other, "doc_id", "left_semi")
    return aligned.unionByName(match(unmatched, threshold))


def align_doc_stats(sentences: DataFrame, aligned: DataFrame) -> DataFrame:
    """Per document: sentence counts, aligned pairs, mean similarity (0 without pairs).

    ``sentences`` may also be the unmerged sentences, which is what the counts refer to.
    """
    pairs = aligned.groupBy("doc_id").agg(
        F.count("*").alias("aligned_pairs"), F.avg("similarity").alias("avg_similarity")
    )
    return (
        side_counts(sentences)
        .join(pairs, "doc_id", "left")
        .select(
            "doc_id",
            "en_sentences",
            "no_sentences",
            F.coalesce("aligned_pairs", F.lit(0)).alias("aligned_pairs"),
            F.coalesce("avg_similarity", F.lit(0.0)).alias("avg_similarity"),
        )
    )


def align_summary(stats: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One line of totals; the rate is NULL when there are no sentences."""
    total = F.greatest(F.sum("en_sentences"), F.sum("no_sentences"))
    weighted = F.sum(F.col("avg_similarity") * F.col("aligned_pairs"))
    return stats.agg(
        F.count("*").alias("total_mt_pairs"),
        F.sum("en_sentences").alias("total_en_sentences"),
        F.sum("no_sentences").alias("total_no_sentences"),
        F.sum("aligned_pairs").alias("total_sentence_pairs"),
        (F.try_divide(F.sum("aligned_pairs"), total) * 100).alias("alignment_rate"),
        F.try_divide(weighted, F.sum("aligned_pairs")).alias("avg_similarity"),
        F.lit(threshold).alias("similarity_threshold"),
    )


def clean_training_pairs(
    aligned: DataFrame, source_lang: str = "en", target_lang: str = "no"
) -> DataFrame:
    """Aligned pairs as training pairs with language codes."""
    ids: list[Column] = [F.col(c) for c in ("doc_id", "en_pos")]
    return aligned.select(
        *ids,
        F.col("en").alias("source"),
        F.col("no").alias("target"),
        F.lit(source_lang).alias("source_lang"),
        F.lit(target_lang).alias("target_lang"),
    )
