"""Writers for sentence pairs, splits and results.

``source`` is the Norwegian and ``target`` the English side, as a translation memory gives them.
Each writer produces a folder of part files; there is no single-file output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitekst.session import materialize, partitions_for

# Language codes and column names of the output formats.
JSONL_CODES = {"source_lang": "nb", "target_lang": "en"}
TSV_HEADER = {"source": "norwegian", "target": "english"}


def write_parallel(df: DataFrame, prefix: str, row_id: str = "pair_id") -> None:
    """``prefix.no`` and ``prefix.en``, line by line the two sides, in order of ``row_id``.

    Both are written from one checkpointed range partitioning, so part files correspond as well.
    Line breaks inside a text become spaces.
    """
    flat = [F.regexp_replace(c, r"[\r\n]+", " ").alias(c) for c in ("source", "target")]
    texts = materialize(df.select(row_id, *flat))
    placed = texts.repartitionByRange(partitions_for(texts), row_id)
    ordered = materialize(placed.sortWithinPartitions(row_id))
    ordered.select("source").write.text(f"{prefix}.no")
    ordered.select("target").write.text(f"{prefix}.en")


def write_tsv(df: DataFrame, path: str, row_id: str = "pair_id") -> None:
    """Tab-separated with header; texts with tabs, quotes or line breaks are quoted."""
    named = [F.col(c).alias(name) for c, name in TSV_HEADER.items()]
    options = {"sep": "\t", "header": True, "quote": '"', "escape": '"'}
    spacing = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(*named).write.options(**options, **spacing).csv(path)


def write_jsonl(df: DataFrame, path: str, row_id: str = "pair_id") -> None:
    codes = [F.lit(code).alias(name) for name, code in JSONL_CODES.items()]
    df.select("source", "target", *codes).write.json(path)


def write_nested(df: DataFrame, path: str, row_id: str = "pair_id") -> None:
    """``{"translation": {"nb": …, "en": …}}``, one object per pair."""
    pair = F.struct(F.col("source").alias("nb"), F.col("target").alias("en"))
    df.select(pair.alias("translation")).write.json(path)


WRITERS: dict[str, Callable[..., None]] = {
    "parallel": write_parallel,
    "tsv": write_tsv,
    "jsonl": write_jsonl,
    "huggingface": write_nested,
    "fairseq": write_parallel,
}


def export_pairs(
    df: DataFrame, path: str, format_type: str = "jsonl", row_id: str = "pair_id"
) -> None:
    """Write pairs in one of the known formats."""
    if format_type not in WRITERS:
        raise ValueError(f"Unknown format: {format_type}")
    WRITERS[format_type](df, path, row_id)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so that reading one of them skips the others."""
    df.write.partitionBy("split").parquet(path)


def write_results(df: DataFrame, path: str) -> None:
    """A result table as JSON lines and, when it is flat, also as CSV with header."""
    df = materialize(df)
    df.write.json(f"{path}.json")
    if not any(t.startswith(("array", "map", "struct")) for _, t in df.dtypes):
        df.write.option("header", True).option("escape", '"').csv(f"{path}.csv")
