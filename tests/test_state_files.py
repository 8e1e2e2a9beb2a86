"""State files are written by many tasks, whatever the size of their table."""

from pyspark.sql import functions as F

from bitekst.plans import queries
from bitekst.sources import readers

SF = "/root/testdata/sf0.01"


def test_files_come_from_several_tasks(spark, monkeypatch):
    seen = []
    read = readers.read_run_logs
    monkeypatch.setattr(readers, "read_run_logs", lambda s, path, *more: seen.append(path) or read(s, path, *more))
    rows = queries.QUERIES["read_state_files"](spark, SF)
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert rows.count() == turns.count()
    assert rows.select("run_id").distinct().count() == turns.select("conv_id").distinct().count()
    files = spark.read.text(seen[0].replace("/*/*/*.txt", ""), wholetext=True).select(F.input_file_name().alias("f"))
    tasks = files.select(F.regexp_extract("f", r"/part-(\d+)-", 1).alias("task")).distinct().count()
    assert tasks > 1
