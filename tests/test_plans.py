"""Properties of the plans, not of the results."""

import re

import pytest
from pyspark.sql import functions as F

from bitekst.operators import corpus, runs, scoring, terminology
from bitekst.plans import inputs

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "pairs")
    inputs.pairs(spark, SF_DIR).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange\b", plan(df)))


def test_row_scores_move_nothing(stored):
    for df in (scoring.bleu_sentence(stored), scoring.chrf_sentence(stored), scoring.row_scores(stored)):
        assert exchanges(df) == 0


def test_reports_move_sums_only(stored):
    text = plan(scoring.evaluate_all(stored, by=("lang",)))
    assert len(re.findall(r"\bExchange\b", text)) == 1
    assert "partial_sum" in text
    assert len(re.findall("FileScan", text)) == 1


def test_scores_read_only_their_columns(stored):
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", plan(scoring.bleu_sentence(stored)))
    assert schema == ["pair_id:bigint,prediction:string,reference:string"]


def test_terms_are_found_and_marked_without_moving_rows(spark, stored):
    glossary = inputs.glossary(spark, SF_DIR)
    for df in (terminology.extract_terms(stored, glossary), terminology.mark_terms(stored, glossary)):
        assert "ArrowEvalPython" in plan(df)
        assert not re.search(r"Exchange|Join|BatchEval", plan(df))


def test_a_large_glossary_is_joined_without_python(spark, stored):
    glossary = inputs.glossary(spark, SF_DIR)
    for search in (terminology.extract_terms, terminology.mark_terms):
        text = plan(search(stored, glossary, walk_bytes=0))
        assert "Join" in text and not re.search(r"ArrowEval|BatchEval|MapIn", text)


def test_subset_filters_without_moving_rows(stored):
    """The subquery shuffles keys; the rows themselves are only filtered."""
    text = plan(corpus.subset(stored, 20))
    main = text.split("Subquery")[0]
    assert "Exchange" not in main and "Filter" in main


def test_subset_pass_over_keys_reads_ids_only(stored):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(corpus.subset(stored, 20)))
    assert schemas.count("pair_id:bigint") >= 2


def test_top_per_key_is_cut_before_the_exchange(spark):
    table = spark.range(100).select(
        (F.col("id") % 3).alias("experiment"), F.col("id").alias("ord"),
        F.rand(3).alias("test_bleu"), F.lit(False).alias("failed"),
    )
    assert plan(runs.top_configs(table, 5, ("experiment",))).count("WindowGroupLimit") == 2


def test_split_reading_prunes_folders(spark, stored, tmp_path):
    from bitekst.sources import readers, writers

    pairs = stored.withColumn("target", F.col("reference"))
    writers.write_splits(corpus.create_splits(pairs), str(tmp_path / "s"))
    val = readers.load_splits(spark, str(tmp_path / "s"))["val"]
    assert re.search(r"PartitionFilters: \[[^\]]*split", plan(val))


def test_task_functions_travel_with_the_job(tmp_path):
    """Executors do not need the package: unpickle in a process that cannot import it."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from bitekst.functions.fuzzy import partial_ratio

    (tmp_path / "f.bin").write_bytes(cloudpickle.dumps(partial_ratio))
    code = "import pickle; print(pickle.load(open('f.bin', 'rb'))('oil', 'an oil'))"
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=60
    )
    assert done.stdout.strip() == "1.0", done.stderr


def test_duplicates_are_dropped_without_moving_texts(stored):
    pairs = stored.withColumn("target", F.col("reference"))
    text = plan(corpus.preprocess_pairs(pairs, lowercase=True))
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    assert "LeftAnti" in text


def test_seed_grid_reads_no_more_than_the_ladder(stored):
    scans = lambda df: plan(df).count("FileScan")
    assert scans(corpus.seed_grid(stored, 20)) <= scans(corpus.nested_subsets(stored))


def test_partitions_follow_the_size_of_the_input(spark, tmp_path):
    from bitekst.functions.scan import CHUNK, ordered_chunks
    from bitekst.session import partitions_for

    wide = spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("x"))
    sizes = []
    for n in (2000, 20000):
        wide.limit(n).write.parquet(str(tmp_path / str(n)))
        df = spark.read.parquet(str(tmp_path / str(n)))
        sizes.append(partitions_for(df, target=20_000))
    assert sizes[1] > 5 * sizes[0]
    rows = [ordered_chunks(spark.range(1000), [], [F.col("id")], chunks=n) for n in (4, 40)]
    assert [r.select(CHUNK).distinct().count() for r in rows] == [4, 40]
    assert rows[0].drop(CHUNK).exceptAll(rows[1].drop(CHUNK)).isEmpty()


def test_temporary_folder_only_for_a_single_process():
    from types import SimpleNamespace

    from bitekst.session import shared_dir

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None))
        with pytest.raises(RuntimeError):
            shared_dir(session)
