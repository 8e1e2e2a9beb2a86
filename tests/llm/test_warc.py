import base64
import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from bitekst.llm import warc
from bitekst.llm.common import stored
from bitekst.session import scratch_path

VERSION = warc.VERSION
bits = st.sampled_from([VERSION, b"WARC/1.1", b"\r\n", b"\r\n\r\n", b"a", b"0\r\n\r\n", b"\x00", b"\xff", b"bc" * 9])


@settings(max_examples=200, deadline=None)
@given(st.lists(bits, max_size=30).map(b"".join), st.integers(2, 40))
def test_framing(payload, size):
    framed = warc.chunked(payload, size)
    assert warc.dechunked(framed) == payload
    assert VERSION not in framed
    parts = list(warc._cuts(framed, size))
    assert b"".join(parts) == framed
    assert all(0 < len(p) <= size for p in parts)


def test_broken_framing():
    for body in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc", b"-1\r\n\r\n"):
        assert warc.dechunked(body) is None
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def pages(spark):
    rng = np.random.default_rng(1)
    rows = [
        (1, "http://a.example/x y\r\nWARC-Type: fake/WARC/1.1", "short"),
        (2, None, "short"),
        (3, "http://b.example", None),
        (4, "http://b.example", ""),
        (5, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n" * 40),
        (6, "u", "é漢😀" * 30000),
        (7, "u", "".join(rng.choice(list("abc \r\n"), 50000))),
        (7, "u", "another text of the same number"),
        (8, "u", "twice"),
        (8, "u", "twice"),
        (None, "u", "nobody"),
        (-4, "u", "short"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string"), rows


def want(rows, least=0):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    head = {}
    for i, p in data:
        if i is not None:
            head[p] = max(i, head.get(p, i))
    out, done = [], set()
    for i, p in data:
        d = base64.b32encode(hashlib.sha1(p).digest()).decode()
        first = len(p) < least or p not in head or (head[p] == i and p not in done)
        done |= {p} if first else set()
        out.append((i, len(p), d, "response" if first else "revisit", None if first else head[p], "ok"))
    return sorted(map(str, out))


def test_round_trip(spark):
    df, rows = pages(spark)
    df = stored(df.repartition(3), "pages")
    for segment, least, split in ((300, 0, "1m"), (16384, 6, "1m"), (1000, 0, "700")):
        path = scratch_path(spark, "warc")
        warc.write_warc(df, path, segment=segment, revisit_from=least)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            read = warc.read_warc(spark, path)
            got = sorted(str(tuple(r)) for r in warc.resolved(read).collect())
            payloads = {r["payload"] for r in read.collect() if r["record_type"] == "response"}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == want(rows, least)
        assert {bytes(p) for p in payloads} == {(h or "").encode() for _, _, h in rows}


def test_archive_is_plain_warc(spark, tmp_path):
    df, _ = pages(spark)
    warc.write_warc(df.coalesce(1), str(tmp_path / "a"), segment=1000)
    data = b"".join(f.read_bytes() for f in (tmp_path / "a" / "records").glob("part-*"))
    at, types = 0, []
    while at < len(data):
        assert data.startswith(VERSION, at)
        end = data.index(b"\r\n\r\n", at)
        headers = dict(x.split(b": ", 1) for x in data[at + len(VERSION) : end].split(b"\r\n"))
        types.append(headers[b"WARC-Type"])
        at = end + 4 + int(headers[b"Content-Length"]) + 4
        assert data[at - 4 : at] == b"\r\n\r\n"
    assert set(types) == {b"response", b"revisit", b"continuation"}


def test_missing_and_repeated_segments(spark, tmp_path):
    payload = b"0123456789" * 50
    first = warc.records(1, 11, "u", payload, None, 100)
    other = warc.records(2, 12, "u", payload, None, 100)
    third = warc.records(3, 13, "u", b"x", "<urn:page:99:9>", 100)
    wrong = [r.replace(b"0123", b"0123", 1) for r in warc.records(4, 14, "u", payload, None, 100)]
    wrong[2] = wrong[2].replace(b"456", b"654", 1)
    folder = tmp_path / "records"
    folder.mkdir()
    records = first[::-1] + first[1:3] + other[:2] + other[3:] + third + wrong
    (folder / "part-0.txt").write_bytes(b"\r\n\r\n".join(records) + b"\r\n\r\n")
    got = {r["page_id"]: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert got[11]["status"] == "ok" and bytes(got[11]["payload"]) == payload
    assert got[12]["status"] == "incomplete" and got[12]["payload"] is None
    assert got[14]["status"] in ("broken", "incomplete")
    assert {r["page_id"]: r["status"] for r in warc.resolved(warc.read_warc(spark, str(tmp_path))).collect()}[13] == "unresolved"


def test_no_pages(spark):
    df, _ = pages(spark)
    path = scratch_path(spark, "warc")
    warc.write_warc(df.limit(0), path)
    assert warc.resolved(warc.read_warc(spark, path)).count() == 0


def test_splits_that_change_between_the_scans(spark, monkeypatch):
    """Revisits find their responses though every file is split otherwise in the second scan."""
    rows = [(i // 2 if i % 50 < 4 else i, f"u{i}", f"page {i % 40} " * 30) for i in range(400)]
    rows += [(900, "u", "many segments " * 10000)] * 3
    path = scratch_path(spark, "pages")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    df = df.selectExpr("*", "'x' as sha", "1L as head", "2L as row", "'y' as payload", "true as tied")
    df.write.option("parquet.block.size", 4096).parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def resplit(*args, **kwargs):
        out = stored(*args, **kwargs)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        return out

    monkeypatch.setattr(warc, "stored", resplit)
    archive = scratch_path(spark, "warc")
    try:
        warc.write_warc(spark.read.parquet(path), archive, segment=1000)
        read = warc.resolved(warc.read_warc(spark, archive, payload=False)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(str(tuple(r)) for r in read) == want(rows)
