"""Stages keep to the right rows when files are split otherwise in a later scan."""

import corpus_pipeline as pipeline
from bitekst.llm import langid, minhash
from bitekst.llm.common import stored
from bitekst.session import scratch_path

SPLIT = "spark.sql.files.maxPartitionBytes"


def splitting(spark, monkeypatch, module, name):
    """From the end of the named function on, every file is split into many parts."""
    real = getattr(module, name)

    def wrapped(*args, **kwargs):
        out = stored(real(*args, **kwargs), "before")
        spark.conf.set(SPLIT, "3000")
        return out

    monkeypatch.setattr(module, name, wrapped)


def table(spark, rows, schema):
    path = scratch_path(spark, "split")
    spark.createDataFrame(rows, schema).repartition(6).write.option("parquet.block.size", 4096).parquet(path)
    return spark.read.parquet(path)


def test_stages(spark, monkeypatch):
    word = lambda i: " ".join(f"word{(i * 31 + k * 17) % 5003}" for k in range(40))
    rows = [(i, word(i) if i % 4 else "12 34 ...", "en", "a") for i in range(400)]
    docs = table(spark, rows, "doc_id long, text string, lang string, source string")
    old = spark.conf.get(SPLIT)
    try:
        splitting(spark, monkeypatch, langid, "identify")
        kept = sorted(r["doc_id"] for r in pipeline.language_id(spark, docs, "").collect())
        assert kept == [i for i in range(400) if i % 4]
        spark.conf.set(SPLIT, old)
        splitting(spark, monkeypatch, minhash, "near_duplicates")
        kept = sorted(r["doc_id"] for r in pipeline.near_dedup(spark, docs, "").collect())
        assert kept == [i for i in range(400) if i % 4 or not i]
    finally:
        spark.conf.set(SPLIT, old)
