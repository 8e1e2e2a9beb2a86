"""Documents in parts: no file holds a fixed share of all sentences."""

import pyarrow.dataset as ds

from bitekst.plans import queries
from bitekst.streaming import progress

SF = "/root/testdata/sf0.001"


def test_parts_lie_in_many_files(spark, monkeypatch):
    seen = []
    align = progress.align_progressively

    def noted(session, source, *more, **named):
        seen.append((source, named["files_per_batch"]))
        return align(session, source, *more, **named)

    monkeypatch.setattr(progress, "align_progressively", noted)
    monkeypatch.setattr(queries, "partitions_for", lambda df: 12, raising=False)
    whole = queries.QUERIES["align_documents"](spark, SF)
    parts = queries.QUERIES["align_document_parts"](spark, SF)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    (source, at_once), = seen
    rows = [f.count_rows() for f in ds.dataset(source.removeprefix("file:"), format="parquet").get_fragments()]
    assert len(rows) == 12 and at_once == 4
    assert max(rows) < sum(rows) / 6
