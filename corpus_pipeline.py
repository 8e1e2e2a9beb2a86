"""Cleaning of a document table for training, stage by stage.

Every stage takes the documents that the one before kept, as a stored table with the columns of
``documents`` (further ones stay), and returns them with the same columns; the last one returns the
pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitekst.llm import decontam, langid, lines, minhash, packing
from bitekst.llm.common import fresh, numbered_once, row_key, stored

#: Smallest share of a document's letters that has to be of one language. Below a half, so that a
#: short document with a licence line or an address of another language stays.
ONE_LANGUAGE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents without letters, and those in which no language has its share of them.

    Learned from the labelled documents themselves; without any, documents are not judged.
    """
    model = langid.learn(docs)
    if not model["langs"]:
        return docs
    held, name = numbered_once(docs)
    found = langid.identify(held, model, spans=False, row=name)
    good = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= ONE_LANGUAGE)
    return held.join(found.filter(~good).select(F.col("row").alias(name)), name, "left_anti").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave boilerplate lines of a source out of its documents; a document of nothing else goes.
    Equal texts of a source count as one page: copies are left to near_dedup. The number of
    characters, where there is one, is counted anew."""
    count = fresh(docs, "n_dropped")
    clean = lines.drop_boilerplate(docs, dropped=count, once=True)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast("long"))
    gone = (F.col(count) > 0) & (F.trim("text") == "")
    return clean.filter(~F.coalesce(gone, F.lit(False))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, the one with the smallest id: texts whose
    shingles of five words have a Jaccard similarity of at least 0.8, and what they connect."""
    held, name = numbered_once(docs)
    stays = minhash.near_duplicates(held, name).filter("stays").select(F.col("row").alias(name))
    return held.join(stays, name, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold an item of the benchmark."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    name, digest = fresh(docs, "leak_id"), fresh(docs, "leak_row")
    leaks = found.select(F.col("doc_id").alias(name), F.col("row").alias(digest)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(name)) & (row_key("doc_id", "text") == F.col(digest))
    return docs.join(leaks, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences; sources in proportion to their tokens."""
    return packing.pack(docs, packing.tokenizer_file()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", pack),
]

#: Trained models, 64-bit hashes and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; every stage's result is written down for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
