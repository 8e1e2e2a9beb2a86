"""Helpers of the operators: stored intermediate tables, batch functions, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitekst.session import scratch_path


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pick(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones cannot clash with what an operator adds."""
    return docs.select(*[docs[n] for n in names])


def by_batch(
    df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str
) -> DataFrame:
    """Apply a function to Arrow batches: lists by column in, lists by column out.

    ``make`` runs once per task, so that models and caches are set up once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows:
                out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                arrays = [pa.array(out[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


ROW = "_llm_row"


def numbered(df: DataFrame) -> DataFrame:
    """Number the rows of a scan. The numbers of a stored table are the same each time it is read
    with the same settings, also when a lost task is repeated."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def numbered_once(df: DataFrame) -> tuple[DataFrame, str]:
    """A stored copy of the table with a row number, and the name of its column. Numbers made anew in
    a second scan mean other rows if the files are split otherwise, as after the loss of an executor;
    these stay with their rows."""
    name = fresh(df, ROW)
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered", "zstd"), name


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows that share an id apart by their text; never null."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b) edges; the label is the smallest node reachable.

    Alternates the large-star and small-star steps: every node is linked to the smallest node known
    around it until nothing changes, a number of rounds that grows with the logarithm of the
    component. Minima are combined before the shuffle and written down, so that adaptive execution
    can split the join of a node with very many neighbours. Edges of null nodes are ignored.
    """
    e = stored(_down(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    before = None
    while (now := _sum(e)) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "links")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        met = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        e = stored(_down(met), "edges")
    root = e.groupBy("u").agg(F.min("v").alias("v"))
    return root.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        root.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _down(e: DataFrame) -> DataFrame:
    e = e.filter("u != v")
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _sum(e: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(e.agg(F.count("*"), digest).first())
