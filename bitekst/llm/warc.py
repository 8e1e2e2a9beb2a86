"""WARC archives: writing with revisits and segments, reading with reassembly.

A record longer than a segment is written as a first record and continuation records that name it
as their origin. Reading groups them by origin, orders them by segment number, verifies numbers and
total length, takes the HTTP response apart, decodes chunked framing and verifies the digest.

Archives are read by Spark's text source with the version line as separator, so that large files
are split among tasks. The writer never lets that line appear inside a record: it cuts chunks within
the mark that the line consists of. A foreign record that holds it is noticed by its Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitekst.llm.common import by_batch, numbered_once, stored
from bitekst.session import scratch_path

MARK = b"WARC/1.1"
VERSION = MARK + b"\r\n"
#: Longest block of a record, size of HTTP chunks, smallest payload that is worth a revisit record.
SEGMENT, CHUNK, REVISIT_FROM = 16384, 4096, 0
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = re.compile(r"<urn:page:(-?\d*):([0-9a-f]+)>")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes, cut inside every mark."""
    start, mark = 0, data.find(MARK)
    while start < len(data):
        stop = min(start + size, len(data))
        if 0 <= mark <= stop - 4:
            stop = mark + 4
            mark = data.find(MARK, stop)
        yield data[start:stop]
        start = stop


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, chunk extensions and trailers ignored; null if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if size == 0:
            return b"".join(out)
        if size < 0 or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return VERSION + lines.encode() + b"\r\n" + block


def records(row: int | str, page_id: int | None, url: str | None, payload: bytes, head: str | None, segment: int) -> list[bytes]:
    """The records of a page without the blank lines behind them: a revisit of ``head``, or a response with
    its continuations."""
    name = f"<urn:page:{'' if page_id is None else page_id}:{row}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    uri = uri.replace(MARK.decode(), "WARC%2F1.1")
    common = [
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if head is not None:
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", head)]
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, *more], http + b"\r\n")]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = list(_cuts(block, segment))
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common]
    if len(parts) == 1:
        return [_record(first, block)]
    out = [_record([*first, ("WARC-Segment-Number", "1")], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        headers = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}:{row}:{i}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", name),
            ("WARC-Segment-Number", str(i)),
        ]
        if i == len(parts):
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(headers, part))
    return out


def write_warc(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    segment: int = SEGMENT,
    revisit_from: int = REVISIT_FROM,
) -> None:
    """Write archives of all pages: of those with equal payloads of at least ``revisit_from`` bytes
    the one with the largest page_id is a response, the others refer to it.

    A null payload is empty; a null url is replaced by the page's name; a null page_id counts as
    the smallest. Every row is a page, and one of equal page_ids with equal payloads is the response.
    Its record is named by page_id and digest, so revisits find it however the files are split in a
    later scan, as after the loss of an executor; further columns are ignored. An empty table gives
    an empty archive.
    """
    rows = pages.select(
        pages[page_id].cast("long").alias("page_id"),
        pages[url].cast("string").alias("url"),
        F.coalesce(pages[html].cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    same = rows.filter(F.octet_length("payload") >= revisit_from).groupBy("sha", "page_id").agg(F.count("*").alias("n"))
    same = same.groupBy("sha").agg(F.sum("n").alias("n"), F.max(F.struct("page_id", "n")).alias("top"))
    same = stored(
        same.filter("n > 1").select("sha", F.col("top.page_id").alias("head"), (F.col("top.n") > 1).alias("tied")), "heads"
    )
    found = rows.join(same, "sha", "left")
    shared, first = F.col("tied").isNotNull(), F.col("page_id").eqNullSafe(F.col("head"))
    if same.filter("tied").isEmpty():
        found = found.withColumn("leads", ~shared | first)
    else:
        # rows equal in page_id and payload: one of them leads, by a number stored with it
        tied = F.coalesce(F.col("tied"), F.lit(False)) & first
        held, number = numbered_once(found.filter(tied))
        lead = stored(held.groupBy("sha").agg(F.max(number).alias("lead")), "leads")
        held = held.join(lead, "sha").withColumn("leads", F.col(number) == F.col("lead")).drop(number, "lead")
        found = found.filter(~tied).withColumn("leads", ~shared | first).unionByName(held)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(F.lit("<urn:page:"), text("head"), F.lit(":"), F.col("sha"), F.lit(">"))
    number = F.monotonically_increasing_id().cast("string")
    placed = found.select(
        F.when(shared & F.col("leads"), F.col("sha")).otherwise(number).alias("row"),
        "page_id", "url", "payload", F.when(~F.col("leads"), head).alias("head"),
    )

    def make():
        def run(b):
            columns = zip(*(b[c] for c in ("row", "page_id", "url", "payload", "head")))
            return {"value": [r for c in columns for r in records(*c, segment)]}

        return run

    out = by_batch(placed, make, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("lineSep", "\r\n\r\n").text(f"{path}/records")


def _parse(value: bytes) -> dict | None:
    """Headers and block of a record; ``whole`` tells whether the block has its full length."""
    end = value.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers = {}
    for line in value[:end].decode("utf-8", "replace").split("\r\n"):
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    size = headers.get("content-length", "")
    block = value[end + 4 :]
    whole = size.isdigit() and len(block) >= int(size)
    return headers | {"block": block[: int(size)] if whole else block, "whole": whole}


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(record_id, page_id, record_type, refers_to_id, uri, payload_bytes, payload_digest, status,
    payload) for every response and revisit.

    ``status`` is ``ok``; ``incomplete`` if a segment or a part of a block is missing; ``broken`` if
    the framing or the digest is wrong. A segment found twice counts once. Revisits have no payload
    of their own.
    """
    raw = spark.read.option("lineSep", VERSION.decode()).text(f"{path}/records")
    raw = raw.select(F.col("value").cast("binary").alias("value")).filter(F.octet_length("value") > 0)
    header = F.substring_index(F.col("value").cast("string"), "\r\n\r\n", 1)
    hint = header.rlike(r"(?im)^[ \t]*warc-segment-")

    def split():
        names = {
            "type": "warc-type", "record_id": "warc-record-id", "uri": "warc-target-uri",
            "digest": "warc-payload-digest", "refers": "warc-refers-to",
        }

        def run(b):
            found = [r for r in map(_parse, b["value"]) if r]
            number = lambda r, k: int(r[k]) if r.get(k, "").isdigit() else None
            out = {k: [r.get(v) for r in found] for k, v in names.items()}
            return out | {
                "origin": [r.get("warc-segment-origin-id") or r.get("warc-record-id") for r in found],
                "segment": [number(r, "warc-segment-number") for r in found],
                "total": [number(r, "warc-segment-total-length") for r in found],
                "whole": [r["whole"] for r in found],
                "block": [r["block"] for r in found],
            }

        return run

    schema = (
        "type string, record_id string, uri string, digest string, refers string, "
        "origin string, segment int, total long, whole boolean, block binary"
    )
    one = by_batch(raw.filter(~hint), split, schema)
    parts = by_batch(raw.filter(hint), split, schema)
    fields = ("type", "record_id", "uri", "digest", "refers")
    first = [
        F.max(F.when(F.coalesce(F.col("segment"), F.lit(1)) == 1, F.col(c))).alias(c) for c in fields
    ]
    piece = F.struct("segment", "total", "whole", "block")
    many = parts.groupBy("origin").agg(*first, F.collect_list(piece).alias("parts"))
    both = one.select(*fields, F.array(piece).alias("parts")).unionByName(many.select(*fields, "parts"))

    def assemble():
        def block(parts):
            if len(parts) == 1 and parts[0]["segment"] is None:
                return parts[0]["block"] if parts[0]["whole"] else None
            by = {p["segment"]: p for p in parts if p["whole"]}
            total = next((p["total"] for p in by.values() if p["total"] is not None), None)
            if sorted(k for k in by if k) != list(range(1, len(by) + 1)):
                return None
            joined = b"".join(by[k]["block"] for k in sorted(by))
            return joined if total == len(joined) else None

        def one_record(kind, claimed, parts):
            whole = block(parts)
            if whole is None:
                return "incomplete", None
            end = whole.find(b"\r\n\r\n")
            if end < 0:
                return "broken", None
            if kind == "revisit":
                return "ok", None
            body = whole[end + 4 :]
            if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", whole[:end]):
                body = dechunked(body)
            if body is None or (claimed and claimed != f"sha1:{digest(body)}"):
                return "broken", None
            return "ok", body

        def run(b):
            done = [one_record(*r) for r in zip(b["type"], b["digest"], b["parts"])]
            ids = [ID.fullmatch(x or "") for x in b["record_id"]]
            return {
                "record_id": b["record_id"],
                "page_id": [int(m[1]) if m and m[1] else None for m in ids],
                "record_type": b["type"],
                "refers_to_id": b["refers"],
                "uri": b["uri"],
                "payload_bytes": [None if p is None else len(p) for _, p in done],
                "payload_digest": [(d or "").removeprefix("sha1:") if p is None else digest(p) for (_, p), d in zip(done, b["digest"])],
                "status": [s for s, _ in done],
            } | ({"payload": [p for _, p in done]} if payload else {})

        return run

    schema = (
        "record_id string, page_id long, record_type string, refers_to_id string, uri string, "
        "payload_bytes long, payload_digest string, status string"
    )
    return by_batch(both, assemble, schema + (", payload binary" if payload else ""))


def resolved(read: DataFrame) -> DataFrame:
    """Records read back, each revisit with the size of the payload that it refers to; a revisit
    whose response is missing or has another digest gets the status ``unresolved``."""
    read = stored(read.drop("payload"), "records")
    heads = stored(
        read.filter("record_type = 'response' and status = 'ok'").join(
            read.filter("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id")).distinct(),
            "record_id", "left_semi",
        ).select(
            F.col("record_id").alias("head"), F.col("page_id").alias("refers_to"),
            F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("sum"),
        ),
        "responses",
    )
    r = read.join(heads, read["refers_to_id"] == heads["head"], "left")
    revisit = F.col("record_type") == "revisit"
    good = F.col("sum") == F.col("payload_digest")
    return r.select(
        "page_id", F.when(revisit, F.col("n")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to",
        F.when(revisit & ~F.coalesce(good, F.lit(False)), "unresolved").otherwise(F.col("status")).alias("status"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages, read the archives back, and describe every page by what was read."""
    path = scratch_path(spark, "archive")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolved(read_warc(spark, path, payload=False))
