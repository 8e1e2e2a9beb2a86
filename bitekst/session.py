"""Session helpers: the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a session of a single process (``local`` or ``local[n]``) may fall back to a temporary
    folder of its own. Nothing is deleted: checkpoints and intermediate files stay in the folder
    until whoever owns it removes them.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="bitekst-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any file system that Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, compressed, and later uses
    read only the columns they need, where a checkpoint holds whole rows as they are."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, target: int = 64 * 1024 * 1024) -> int:
    """Number of partitions of about ``target`` bytes each, at least the configured number.

    The bytes are measured, in one aggregate: estimates of joined or checkpointed tables can be off
    by any factor. So ``df`` should be a stored or checkpointed table.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, size_in_bytes(df) // target + 1)


def size_in_bytes(df: DataFrame) -> int:
    """Bytes of the rows, measured in one aggregate; nested values by their JSON text."""
    per_row = sum((_bytes(F.col(name), kind) for name, kind in df.dtypes), F.lit(16))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("bytes")).first()["bytes"]


def _bytes(col: Column, kind: str) -> Column:
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) + 16
    return F.lit(16)


def broadcast_if_small(df: DataFrame, max_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Hint a broadcast only after measuring the table; otherwise leave the join to the planner.

    The table is written down first, so that it is computed once for the measurement and the join.
    """
    df = materialize(df)
    return F.broadcast(df) if size_in_bytes(df) <= max_bytes else df
