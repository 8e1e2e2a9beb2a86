"""Readers: translation memories, pair files, glossaries, run logs, split tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitekst.functions.text import strip
from bitekst.operators.corpus import SEED, subset
from bitekst.session import broadcast_if_small, materialize

# Language codes of a translation memory and schemas of the input files.
TMX_SOURCE, TMX_TARGET = "nb", "en"
TMX_SCHEMA = "tuv array<struct<`_xml:lang`: string, seg: struct<_VALUE: array<string>>>>"
PAIR_SCHEMA = "source string, target string, metadata map<string,string>"
GLOSSARY_SCHEMA = "en string, no string"
RUN_STATE_SCHEMA = (
    "best_metric double, max_steps int, log_history array<struct<epoch: double, step: long, "
    "loss: double, learning_rate: double, eval_bleu: double, eval_chrf: double, "
    "eval_loss: double, eval_runtime: double>>"
)


def _place() -> list[Column]:
    """Where a row stands: its file, its split of the file, and its row in the order of the task."""
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    ]


def numbered(df: DataFrame, row_id: str | None) -> DataFrame:
    """Replace the columns of ``_place`` by a dense number in the order (file, place in the file).

    The rows are written down once, so that all passes see the same splits; the rows before a split
    come from one line per split, and no text is shuffled. The numbers do not depend on the splits.
    """
    plain = df.drop("_file", "_block", "_row")
    if row_id is None:
        return plain
    rows = materialize(df)
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_row").alias("first"))
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    splits = splits.select("_file", "_block", shift.alias("shift"))
    placed = rows.join(broadcast_if_small(splits), ["_file", "_block"])
    return placed.select((F.col("_row") + F.col("shift")).alias(row_id), *plain.columns)


def read_tmx(
    spark: SparkSession,
    path: str,
    source_lang: str = TMX_SOURCE,
    target_lang: str = TMX_TARGET,
    joined: bool = False,
    row_id: str | None = "pair_id",
) -> DataFrame:
    """(row_id, source, target) of every translation unit that has both languages.

    Language codes must match exactly; of several non-empty variants in a language the last wins.
    The text of a segment is its first text node, or all of them with ``joined``. ``row_id`` numbers
    the pairs from 0 in the order of the files and of the units in them.
    """
    units = spark.read.format("xml").option("rowTag", "tu").schema(TMX_SCHEMA).load(path)

    def node_text(variant: Column) -> Column:
        nodes = variant["seg"]["_VALUE"]
        raw = F.array_join(nodes, "") if joined else F.get(nodes, F.lit(0))
        return strip(F.coalesce(raw, F.lit("")))

    def last_text(lang: str) -> Column:
        texts = F.transform(
            F.filter("tuv", lambda v: v["_xml:lang"] == lang), node_text
        )
        return F.try_element_at(F.filter(texts, lambda t: t != ""), F.lit(-1))

    pairs = (
        units.filter(F.size("tuv") >= 2)
        .select(last_text(source_lang).alias("source"), last_text(target_lang).alias("target"), *_place())
        .filter("source is not null and target is not null")
    )
    return numbered(pairs, row_id)


def read_pairs_json(
    spark: SparkSession, path: str, lines: bool = False, row_id: str | None = "pair_id"
) -> DataFrame:
    """Pairs from a JSON array (or, splittable, from JSON lines); missing texts become ''.

    A JSON array is read by one task per file, so large corpora belong in many files or in lines.
    ``row_id`` numbers the rows from 0 in the order of the files and of the rows in them, however
    the files are split.
    """
    raw = spark.read.schema(PAIR_SCHEMA).option("multiLine", not lines).json(path)
    empty = F.create_map().cast("map<string,string>")
    out = raw.select(
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("target", F.lit("")).alias("target"),
        F.coalesce("metadata", empty).alias("metadata"),
        *_place(),
    )
    return numbered(out, row_id)


def read_document_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(doc_id, en_text, no_text) from the same shape of file."""
    pairs = read_pairs_json(spark, path, lines, "doc_id")
    return pairs.select(
        (F.col("doc_id") + 1).alias("doc_id"),
        F.col("source").alias("en_text"),
        F.col("target").alias("no_text"),
    )


def read_glossary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(ord, en, no) entries; ``ord`` is the place: file, offset of the block, row."""
    raw = spark.read.schema(GLOSSARY_SCHEMA).option("multiLine", not lines).json(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.select(place.alias("ord"), "en", "no")


def read_run_logs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per logged step, with the file as ``run_id``; absent values are null."""
    raw = spark.read.schema(RUN_STATE_SCHEMA).option("multiLine", not lines).json(path)
    states = raw.select(F.input_file_name().alias("run_id"), "*")
    return run_log_rows(states, "run_id")


def run_log_rows(states: DataFrame, *ids: str) -> DataFrame:
    """Explode the log of each run state."""
    return states.select(*ids, F.inline("log_history"))


def load_splits(
    spark: SparkSession,
    path: str,
    use_subset: int | None = None,
    seed: int = SEED,
    row_id: str = "pair_id",
) -> dict[str, DataFrame]:
    """train, val and test of a table written by ``write_splits``; the training part on request
    cut down to a seeded subset. Each part reads only its own folder."""
    table = spark.read.parquet(path)
    parts = {s: table.filter(F.col("split") == s) for s in ("train", "val", "test")}
    if use_subset is not None:
        parts["train"] = subset(parts["train"], use_subset, seed, row_id)
    return parts

