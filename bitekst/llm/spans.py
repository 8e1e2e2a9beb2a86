"""Substring de-duplication over sliding spans of sentences.

Runs of consecutive sentences with enough sentences and words are hashed to 128 bits: the shortest
from each sentence on and the shortest up to each sentence. Where a longer run is repeated, those
inside it are too, and they cover it to its first and last sentence. The first place of every hash in the order of (doc_id, row,
sentence) is found by a combined minimum; the runs that stand elsewhere cover sentences to remove.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitekst.llm.common import by_batch, pick, row_key, stored

SENTENCES, WORDS = 2, 12
#: A sentence with the white space behind it: up to closing marks before white space, or a line end.
#: White space before the first sentence belongs to it, so every sentence of a text with words has one.
#: It looks at ASCII characters only, so it cuts UTF-8 as well as text.
PIECE = re.compile(rb"(?:\A[ \t\n\r\f\v]*+)?+[^.!?\n]*+(?:[.!?]++[^ \t\n\r\f\v.!?][^.!?\n]*+)*+[.!?]*+[ \t\n\r\f\v]*+")


def pieces(text: bytes) -> list[bytes]:
    """The sentences of a text; together they are the text."""
    return [p for p in PIECE.findall(text) if p]


def runs(sizes: list[int], sentences: int, least: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs that are long enough from each sentence on, and up to each
    sentence, of the numbers of words of the sentences."""
    last = len(sizes) - 1
    upto = _shortest(sizes[::-1], sentences, least)
    return sorted({*_shortest(sizes, sentences, least), *((last - j, last - i) for i, j in upto)})


def _shortest(sizes: list[int], sentences: int, least: int) -> list[tuple[int, int]]:
    ends, out, j, total = len(sizes), [], -1, 0
    for i in range(ends):
        while j + 1 < ends and (j + 1 < i + sentences or total < least):
            j += 1
            total += sizes[j]
        if j + 1 < i + sentences or total < least:
            break
        out.append((i, j))
        total -= sizes[i]
    return out


def span_runs(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(doc_id, row, first, last, h1, h2): the hashed runs of every text."""

    def make():
        def run(b: dict) -> dict:
            out = {k: [] for k in ("doc_id", "row", "first", "last")}
            hashes = []
            for doc_id, row, text in zip(b["doc_id"], b["row"], b["text"]):
                split = [p.split() for p in pieces(text or b"")]
                found = runs([len(w) for w in split], sentences, words)
                plain = [b" ".join(w) for w in split]
                hashes += [xxhash.xxh3_128_digest(b" ".join(filter(None, plain[i : j + 1]))) for i, j in found]
                out["doc_id"] += [doc_id] * len(found)
                out["row"] += [row] * len(found)
                out["first"] += [i for i, _ in found]
                out["last"] += [j for _, j in found]
            halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            return out | {"h1": np.ascontiguousarray(halves[:, 0]), "h2": np.ascontiguousarray(halves[:, 1])}

        return run

    texts = pick(docs, "doc_id", "text").select("doc_id", row_key("doc_id", "text").alias("row"), F.col("text").cast("binary"))
    return by_batch(texts, make, "doc_id long, row long, first int, last int, h1 long, h2 long")


def repeated_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(doc_id, row, first, last): the runs that stand at an earlier place already."""
    found = span_runs(docs, sentences, words)
    place = F.struct("doc_id", "row", "first")
    first = found.groupBy("h1", "h2").agg(
        F.count("*").alias("n"),
        F.min(place).alias("place"),
    )
    first = stored(first.filter("n > 1").select("h1", "h2", "place"), "repeated")
    return found.join(first, ["h1", "h2"]).filter(place != F.col("place")).select(
        "doc_id", "row", "first", "last"
    )


def remove_repeated(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text): every text without the sentences that a repeated
    run covers; one row per row of ``docs``.

    The first place of a run stays. A text shorter than a run is left as it is; null stays null
    (no sentences), an empty text empty; a text that is all repeated becomes empty. Rows equal in
    doc_id and text are one document and get the same result; a null doc_id comes first in order.
    """
    covered = repeated_spans(docs, sentences, words)
    gone = covered.groupBy("doc_id", "row").agg(
        F.collect_set(F.struct("first", "last")).alias("spans")
    )
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("row").alias("_r"), "spans")
    texts = pick(docs, "doc_id", "text").withColumn("row", row_key("doc_id", "text"))
    on = (texts["row"] == gone["_r"]) & texts["doc_id"].eqNullSafe(gone["_id"])
    joined = texts.join(gone, on, "left").select(
        "doc_id",
        F.col("text").cast("binary").alias("text"),
        F.transform("spans", lambda s: s["first"]).alias("firsts"),
        F.transform("spans", lambda s: s["last"]).alias("lasts"),
    )

    def make():
        def one(text, firsts, lasts):
            if text is None:
                return 0, 0, None
            p = pieces(text)
            if not firsts:
                return len(p), 0, text
            drop = bytearray(len(p))
            upto = 0
            for i, j in sorted(zip(firsts, lasts)):
                for k in range(max(i, upto), j + 1):
                    drop[k] = 1
                upto = max(upto, j + 1)
            return len(p), sum(drop), b"".join(x for x, d in zip(p, drop) if not d)

        def run(b):
            done = [one(*r) for r in zip(b["text"], b["firsts"], b["lasts"])]
            return {
                "doc_id": b["doc_id"],
                "n_sentences": [d[0] for d in done],
                "n_removed": [d[1] for d in done],
                "text": [d[2] for d in done],
            }

        return run

    out = by_batch(joined, make, "doc_id long, n_sentences long, n_removed long, text binary")
    return out.withColumn("text", F.col("text").cast("string"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, n_removed and the text that is left, for all documents."""
    return remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
