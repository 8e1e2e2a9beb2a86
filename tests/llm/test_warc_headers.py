"""Archive records with long headers."""

from bitekst.llm import warc
from bitekst.llm.common import stored
from bitekst.session import scratch_path


def test_long_urls_with_segments(spark):
    rows = [(1, "http://a.example/" + "x" * 10_000, "text " * 20_000), (2, "http://b.example/" + "y" * 3_900, "other " * 9_000)]
    rows.append((3, "WARC-Segment-Number: 7", "short"))
    pages = stored(spark.createDataFrame(rows, "page_id long, url string, html string"), "pages")
    path = scratch_path(spark, "warc")
    warc.write_warc(pages, path)
    found = {r["page_id"]: r for r in warc.read_warc(spark, path).collect()}
    assert set(found) == {1, 2, 3}
    assert all(found[i]["status"] == "ok" and bytes(found[i]["payload"]).decode() == t for i, _, t in rows)
    assert [found[i]["uri"] for i in (1, 2)] == [u for _, u, _ in rows[:2]]
