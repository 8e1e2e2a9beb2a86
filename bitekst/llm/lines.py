"""Line de-duplication by site-relative frequency.

A line that stands on more than a given share of a site's pages is boilerplate of that site and is
dropped there. Lines are counted once per page, as a pair of 64-bit hashes, combined before the
shuffle; the boilerplate lines of a site are few, since all the lines of its pages have to share
the pages: at most (average lines per page) / ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitekst.llm.common import fresh, row_key, stored

RATIO, MIN_PAGES = 0.02, 5


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def _hashes(text: Column) -> Column:
    """The hash of every line without its outer spaces; null for blank lines."""
    return F.transform(
        F.split(text, "\n"), lambda x: F.when(F.trim(x) != "", _hash(F.trim(x)))
    )


def boilerplate(
    pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, once: bool = False
) -> DataFrame:
    """(host, line): hashes of the lines on more than ``ratio`` of the pages of their host and on
    at least ``min_pages``. A null host is a host of its own. With ``once`` pages of equal text
    (128-bit hash) on one host are one page, for the lines and for the number of pages."""
    p = pages.select(pages[host].alias("host"), pages[text].alias("text"))
    p = p.select("host", "text", F.array_distinct(F.array_compact(_hashes(F.col("text")))).alias("lines"))
    if once:
        p = p.groupBy("host", _hash(F.col("text")).alias("page")).agg(F.any_value("lines").alias("lines"))
        p = stored(p, "pages")
    lines = p.select("host", F.explode("lines").alias("line"))
    often = lines.groupBy("host", "line").count().filter(F.col("count") >= min_pages)
    total = p.groupBy("host").agg(F.count("*").alias("pages"))
    both = often.alias("o").join(
        stored(total, "hosts").alias("t"), F.col("o.host").eqNullSafe(F.col("t.host"))
    )
    return both.filter(F.col("count") > ratio * F.col("pages")).select("o.host", "line")


def drop_boilerplate(
    pages: DataFrame,
    id_col: str = "doc_id",
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    dropped: str | None = None,
    once: bool = False,
) -> DataFrame:
    """The pages with their boilerplate lines left out; every other column stays.

    Lines are compared without outer spaces; blank lines stay. A null text stays null, an empty
    one empty, and a text of nothing but boilerplate becomes empty. Every row is a page: repeated
    rows count each and are treated alike; with ``once`` pages of equal text on one host count as one
    page, so that copies alone make no line boilerplate. ``dropped`` names a column for the number of
    lines left out; it replaces one of that name.
    """
    found = stored(boilerplate(pages, host, text, ratio, min_pages, once), "boilerplate")
    p = pages.select(
        pages[id_col].alias("id"), row_key(id_col, text).alias("row"),
        pages[host].alias("host"), pages[text].alias("text"),
    )
    lines = p.select(
        "id", "row", "host", F.explode(F.array_distinct(F.array_compact(_hashes(F.col("text"))))).alias("line")
    ).alias("l")
    f = found.alias("f")
    same = F.col("l.host").eqNullSafe(F.col("f.host")) & (F.col("l.line") == F.col("f.line"))
    hits = lines.join(f, same, "left_semi").groupBy("id", "row", "host").agg(
        F.collect_set("line").alias("lines")
    )
    row, gone = fresh(pages, "_row"), fresh(pages, "_lines")
    hits = hits.select(
        F.col("id").alias("_hit_id"), F.col("row").alias("_hit_row"),
        F.col("host").alias("_hit_host"), F.col("lines").alias(gone),
    )
    keyed = pages.withColumn(row, row_key(id_col, text))
    on = (
        (keyed[row] == hits["_hit_row"])
        & keyed[id_col].eqNullSafe(hits["_hit_id"])
        & keyed[host].eqNullSafe(hits["_hit_host"])
    )
    joined = keyed.join(hits, on, "left")
    all_lines = F.split(keyed[text], "\n")
    kept = F.filter(all_lines, lambda x: ~F.array_contains(hits[gone], _hash(F.trim(x))))
    clean = F.when(hits[gone].isNull(), keyed[text]).otherwise(F.array_join(kept, "\n"))
    n = F.when(hits[gone].isNull(), 0).otherwise(F.size(all_lines) - F.size(kept))
    out = [clean.alias(c) if c == text else keyed[c] for c in pages.columns if c != dropped]
    return joined.select(*out, *([n.cast("long").alias(dropped)] if dropped else []))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, dropped lines and what is left of the text, for all documents; a source is a site."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs, dropped="n_dropped").select("doc_id", "n_dropped", "text")
