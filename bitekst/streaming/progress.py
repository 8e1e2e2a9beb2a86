"""Alignment with progressive saves.

New files of sentences are aligned batch by batch and appended, so each result is written once; a
restarted job goes on where it stopped.

A document may arrive in parts. Its sentences are then kept, each in the batch that brought it,
until the document is complete; one line per open document says what has come so far. A batch reads
the folders of earlier batches only and replaces its own, so it may be repeated after a crash at any
place. Nothing of a document is held in one task: parts are rows of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitekst.operators.alignment import THRESHOLD, align_doc_stats, align_documents
from bitekst.session import materialize, path_exists

#: What is known of an open document: its first and latest batch, sentences so far, end seen.
OPEN = ("doc_id", "first_batch", "last_batch", "seen", "expected", "ended")


def align_progressively(
    spark: SparkSession,
    sentences_path: str,
    out_path: str,
    checkpoint_path: str,
    threshold: float = THRESHOLD,
    files_per_batch: int = 1000,
    end: str | None = None,
    idle_batches: int | None = None,
) -> None:
    """Align everything that is there and not yet done; pairs and statistics go to ``out_path``.

    Both tables carry ``batch_id``; a batch that is run again replaces its own folder, so a crash
    between the two writes leaves no duplicates.

    Without ``end`` the sentences of a document must arrive in one batch. With it, ``end`` names a
    column that tells when a document is complete: a boolean that is true in the last of its sentences
    to arrive, or a whole number, the sentences of the document on both sides together (parts may then
    come in any order; where numbers differ the largest counts). A document of which nothing came for
    ``idle_batches`` batches is aligned as it is; so is every open one by :func:`finish_open`. Null marks
    are none. Sentences without a document id count as one document that has no pairs.

    A document of which sentences come after it was aligned stops the job with an error, before
    anything of that batch is saved.
    """
    schema = spark.read.parquet(sentences_path).schema
    if end is None and idle_batches is not None:
        raise ValueError("idle_batches needs a column that marks the end of documents")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch = materialize(batch)
        _refuse_known(spark, batch, out_path, batch_id)
        if end is not None:
            batch = _complete(spark, batch, out_path, batch_id, end, idle_batches)
        _align(batch, out_path, batch_id, threshold)

    (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(sentences_path)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def finish_open(spark: SparkSession, out_path: str, threshold: float = THRESHOLD) -> None:
    """Align the documents that are still open with what has come of them.

    To be called between runs of :func:`align_progressively`; their rows have a negative
    ``batch_id``. Calling it again after a crash repeats the same work.
    """
    if not path_exists(spark, f"{out_path}/open"):
        return
    last = _part(spark, out_path, "open").agg(F.max("batch_id")).first()[0]
    if last is None:  # every document was complete in each batch so far
        return
    mine = -(last + 1)
    held = materialize(_open_documents(spark, out_path, last + 1, but=mine))
    _align(_kept(spark, out_path, last + 1, held), out_path, mine, threshold)


def read_progress(spark: SparkSession, out_path: str, name: str = "pairs") -> DataFrame:
    """The saved ``pairs`` or ``stats`` of all batches so far."""
    return _part(spark, out_path, name)


def open_documents(spark: SparkSession, out_path: str) -> DataFrame:
    """The documents that have begun and are not aligned yet, with what is known of them."""
    last = _part(spark, out_path, "open").agg(F.max("batch_id")).first()[0]
    return _open_documents(spark, out_path, (-1 if last is None else last) + 1)


def _part(spark: SparkSession, out_path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out_path}/{name}").withColumn("batch_id", F.col("batch_id").cast("long"))


def _align(sentences: DataFrame, out_path: str, batch_id: int, threshold: float) -> None:
    pairs = materialize(align_documents(sentences, threshold))
    stats = align_doc_stats(sentences, pairs)
    for name, table in (("pairs", pairs), ("stats", stats)):
        table.write.mode("overwrite").parquet(f"{out_path}/{name}/batch_id={batch_id}")


def _refuse_known(spark: SparkSession, batch: DataFrame, out_path: str, batch_id: int) -> None:
    if not path_exists(spark, f"{out_path}/stats"):  # nothing is saved yet
        return
    earlier = read_progress(spark, out_path, "stats").filter(F.col("batch_id") != batch_id)
    again = _of(batch.select("doc_id").distinct(), earlier).limit(5).collect()
    if again:
        ids = ", ".join(str(r["doc_id"]) for r in again)
        raise ValueError(f"documents spread over several batches: {ids}")


def _of(rows: DataFrame, documents: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of the given documents, or with ``left_anti`` of all others."""
    ids = documents.select(F.col("doc_id").alias("_doc"))
    return rows.join(ids, rows["doc_id"].eqNullSafe(F.col("_doc")), how)


def _open_documents(spark: SparkSession, out_path: str, batch_id: int, but: int | None = None) -> DataFrame:
    """What the batch before left open, without the documents that :func:`finish_open` has aligned."""
    left = _part(spark, out_path, "open").filter(F.col("batch_id") == batch_id - 1).select(*OPEN)
    if not path_exists(spark, f"{out_path}/stats"):
        return left
    finished = read_progress(spark, out_path, "stats").filter(F.col("batch_id") < 0)
    return _of(left, finished.filter(F.col("batch_id") != but) if but else finished, "left_anti")


def _kept(spark: SparkSession, out_path: str, batch_id: int, documents: DataFrame) -> DataFrame:
    """The sentences that earlier batches kept of the documents; batches before their first are not read."""
    since = documents.agg(F.min("first_batch")).first()[0]
    parts = _part(spark, out_path, "parts")
    span = F.col("batch_id").between(batch_id if since is None else since, batch_id - 1)
    return _of(parts.filter(span).drop("batch_id"), documents)


def _complete(
    spark: SparkSession, batch: DataFrame, out_path: str, batch_id: int, end: str, idle: int | None
) -> DataFrame:
    """The sentences, of this and earlier batches, of the documents that are complete now; those of
    all others are kept."""
    came = batch.groupBy("doc_id").agg(F.count("*").alias("seen"), *_marks(batch, end))
    now = came.select(
        "doc_id", F.lit(batch_id).cast("long").alias("first_batch"),
        F.lit(batch_id).cast("long").alias("last_batch"), "seen", "expected", "ended",
    )
    if batch_id:
        now = _open_documents(spark, out_path, batch_id).unionByName(now)
    now = now.groupBy("doc_id").agg(
        F.min("first_batch").alias("first_batch"),
        F.max("last_batch").alias("last_batch"),
        F.sum("seen").alias("seen"),
        F.max("expected").alias("expected"),
        F.bool_or("ended").alias("ended"),
    )
    done = F.col("ended") | F.coalesce(F.col("seen") >= F.col("expected"), F.lit(False))
    if idle is not None:
        done |= F.col("last_batch") <= batch_id - idle
    now = materialize(now.withColumn("done", done))
    closed, left = now.filter("done"), now.filter("not done").select(*OPEN)
    batch_rows = batch.drop(end)
    whole = _of(batch_rows, closed)
    if batch_id:
        whole = whole.unionByName(_kept(spark, out_path, batch_id, closed))
    whole = materialize(whole)
    for name, table in (("parts", _of(batch_rows, closed, "left_anti")), ("open", left)):
        table.write.mode("overwrite").parquet(f"{out_path}/{name}/batch_id={batch_id}")
    return whole


def _marks(batch: DataFrame, end: str) -> tuple[Column, Column]:
    """The sentences expected and whether the end is marked, per document."""
    if dict(batch.dtypes)[end] == "boolean":
        return F.lit(None).cast("long").alias("expected"), F.coalesce(F.bool_or(end), F.lit(False)).alias("ended")
    return F.max(F.col(end).cast("long")).alias("expected"), F.lit(False).alias("ended")
