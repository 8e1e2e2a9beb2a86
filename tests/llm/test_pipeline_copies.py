"""What the stages do with copies."""

import corpus_pipeline as pipeline
from bitekst.llm.common import stored


def test_one_of_many_copies_survives(spark):
    clean = "The harbour was quiet that morning.\nTwo boats came in before the fog had lifted."
    rows = [(i, clean, "en", "a") for i in range(30)]
    rows += [(100 + i, f"menu\nPage {i} has words of its own, such as w{i} and v{i * i}.", "en", "a") for i in range(20)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "copies")
    out = stored(pipeline.line_dedup(spark, docs, ""), "lines")
    # all copies keep their lines; a line of different pages still goes
    assert out.filter("doc_id < 100").select("text").distinct().collect() == [(clean,)]
    assert not any("menu" in r["text"] for r in out.collect())
    kept = {r["doc_id"]: r["text"] for r in pipeline.near_dedup(spark, out, "").collect()}
    assert kept[0] == clean and not set(range(1, 30)) & set(kept)
    assert set(kept) > {100, 119}
