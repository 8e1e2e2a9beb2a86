from pyspark.sql import functions as F

from bitekst.llm import pii


def test_trees_and_thresholds_see_all_candidates(spark, monkeypatch):
    """Before, about 8,000 candidates were drawn."""
    seen = []

    class Watched(pii.GBTClassifier):
        def fit(self, rows):
            seen.append(rows.agg(F.sum("n")).first()[0])
            return super().fit(rows)

    limits = pii._limits

    def watched(scored, precision):
        seen.append(scored.agg(F.sum("n")).first()[0])
        return limits(scored, precision)

    monkeypatch.setattr(pii, "GBTClassifier", Watched)
    monkeypatch.setattr(pii, "_limits", watched)
    text = F.concat(F.lit("call 020 7946 0"), F.lpad(F.col("id").cast("string"), 5, "7"), F.lit(" or 4711/22"))
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), text.alias("text"))
    spans = pii._found(docs, "doc_id", "text").select("doc_id", "row", F.inline("proposed")).persist()
    # Base spans are learned from, but nothing is calibrated on them.
    taken = spans.filter("not base or pmod(xxhash64(doc_id, row, start, end, kind), 3) != 0").count()
    pii.choose(spans).collect()
    assert sum(seen) == taken > 30000
