"""Benchmark decontamination by template canonicalisation.

Words are canonicalised: numbers, units behind numbers, and names (capitalised words inside a
sentence) become typed placeholders, all others are lower-cased. Windows of five such words are
hash-joined between benchmark items and documents. Windows that lie alike in both (same diagonal)
must fill their slots consistently: one value of the item always by one value of the document and
the other way round. A document holds an item if enough of the item's windows are found like that,
so a question with other numbers and names is caught, and another text on the same template is not.

An item and a document that share a share ``t`` of ``n`` windows share one of any ``n - ceil(t n)
+ 1`` of them: pairs are made over the rarest windows only, and all windows are then compared for
these pairs.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitekst.llm.common import row_key, stored

WINDOW, SHARE = 5, 0.8
#: Words of a window that have to be literal, so that placeholders alone never match.
LITERAL = 3
#: Units that follow a number, spelled numbers.
UNITS = frozenset(
    "% $ € £ mm cm m km in inch inches ft feet yard yards mile miles mg g kg t lb lbs oz ounce ounces ml cl l "
    "liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days "
    "week weeks month months year years km/h mph kb mb gb tb w kw kwh v a hz °c °f degree degrees percent cent "
    "cents dollar dollars euro euros pound pounds".split()
)
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "billion".split()
)
NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?")
MEASURE = re.compile(r"([+-]?\d+(?:[.,:/]\d+)*)([^\W\d_]+)")
#: log2 of the bits of the filter that drops most windows before the join; its size is fixed.
FILTER_BITS = 23
_MUL = 0x9E3779B97F4A7C15
_TAG = {"number": 0x1F0A2B3C4D5E6F71, "unit": 0x2B7E151628AED2A7, "name": 0x3243F6A8885A308D}
#: Distinct words remembered by a task.
KNOWN = 400_000
#: Texts handled at once.
ROWS = 1000


NUMERIC, UNIT, CAPITAL, ENDS = 1, 2, 4, 8


class Words:
    """Raw words, remembered with the hash of their literal form and their properties."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.cores: list[str] = []
        self.literal, self.props = array("Q"), bytearray()

    def add(self, raw: str) -> int:
        if raw in self.ids:
            return self.ids[raw]
        core = raw.strip("\"'“”‘’«»()[]{}<>.,;:!?…*_#-–—") or raw
        low = core.lower()
        number = NUMBER.fullmatch(core) or MEASURE.fullmatch(core) or low in NUMBERS
        ends = raw.rstrip("\"'”’»)]}").endswith((".", "!", "?", "…"))
        self.literal.append(xxhash.xxh64_intdigest(low.encode("utf-8", "surrogatepass")))
        self.props.append(
            NUMERIC * bool(number) + UNIT * (low in UNITS) + CAPITAL * core[0].isupper() + ENDS * ends
        )
        self.cores.append(low)
        self.ids[raw] = len(self.cores) - 1
        return len(self.cores) - 1

    def of(self, raws: list[str]) -> list[int]:
        got = list(map(self.ids.get, raws))
        return [self.add(r) if i is None else i for r, i in zip(raws, got)] if None in got else got


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _windows(texts: list[str | None], words: Words):
    """Template windows of a batch: text number, position, hash, and what the slots need."""
    if len(words.cores) > KNOWN:
        words.clear()
    ids, sizes = [], []
    for t in texts:
        got = words.of(t.split()) if t else []
        ids += got
        sizes.append(len(got))
    n = len(ids)
    if n < WINDOW:
        return None
    ids = np.array(ids)
    props = np.frombuffer(words.props, np.uint8)[ids]
    starts = np.cumsum([0, *sizes[:-1]])
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first = first[:n]
    opens = np.concatenate([[True], (props[:-1] & ENDS) > 0]) | first
    is_number = (props & NUMERIC) > 0
    is_unit = ((props & UNIT) > 0) & np.concatenate([[False], is_number[:-1]]) & ~first & ~is_number
    is_name = ((props & CAPITAL) > 0) & ~opens & ~is_number & ~is_unit
    h = np.frombuffer(words.literal, np.uint64)[ids]
    kind = np.zeros(n, np.int8)
    for k, (name, where) in enumerate((("number", is_number), ("unit", is_unit), ("name", is_name)), 1):
        h[where] = np.uint64(_TAG[name])
        kind[where] = k
    count = n - WINDOW + 1
    total = np.zeros(count, np.uint64)
    for k in range(WINDOW):
        total = total * np.uint64(_MUL) + _mix(h[k : k + count])
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    slots = np.concatenate([[0], np.cumsum(kind > 0)])
    literal = WINDOW - (slots[WINDOW:] - slots[:-WINDOW])
    ok = (text_of[:count] == text_of[WINDOW - 1 :]) & (literal >= LITERAL)
    return ids, kind, starts, text_of, _mix(total), ok


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & np.uint64((1 << FILTER_BITS) - 1), (h >> np.uint64(32)) & np.uint64((1 << FILTER_BITS) - 1)


def template_windows(df: DataFrame, id_col: str, text_col: str, bits: bytes | None = None) -> DataFrame:
    """(id, row, pos, size, h, slots): the template windows of every text with enough literal words.

    ``size`` is the number of such windows of the text; ``slots`` lists type and value of the
    placeholders. With ``bits`` only windows that the filter may hold are returned.
    """
    schema = pa.schema(
        [
            ("id", pa.int64()), ("row", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()),
            ("h", pa.int64()), ("slots", pa.list_(pa.string())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        mask = None if bits is None else np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            found = _windows(batch.column(2).to_pylist(), words)
            if found is None:
                continue
            ids, kind, starts, text_of, h, ok = found
            size = np.bincount(text_of[: len(ok)][ok], minlength=batch.num_rows)
            at = np.flatnonzero(ok)
            if mask is not None:
                one, two = _places(h[at])
                at = at[mask[one] & mask[two]]
            if not len(at):
                continue
            text = text_of[at]
            slots = [
                [f"{kind[j]}:{words.cores[ids[j]]}" for j in range(i, i + WINDOW) if kind[j]] for i in at.tolist()
            ]
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array((at - starts[text]).astype(np.int32)), pa.array(size[text].astype(np.int32)),
                    pa.array(h[at].view(np.int64)), pa.array(slots, pa.list_(pa.string())),
                ],
                schema=schema,
            )

    texts = df.select(
        df[id_col].cast("long").alias("id"), row_key(id_col, text_col).alias("row"), df[text_col].alias("text")
    )
    return texts.mapInArrow(run, "id long, row long, pos int, size int, h long, slots array<string>")


def _filter(windows: DataFrame) -> bytes:
    """A Bloom filter of the benchmark's hashes. Its size is fixed, at most 2^17 rows of 64 bits
    come to the driver; with more hashes it lets more through, and the join decides."""
    mask = F.lit((1 << FILTER_BITS) - 1).cast("long")
    places = F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))
    at = windows.select(F.explode(places).alias("p")).select(
        F.floor(F.col("p") / 64).cast("int").alias("word"),
        F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"),
    )
    rows = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in rows:
        out[r["word"]] = r["bits"]
    return out.tobytes()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, row, item_id, n_windows, n_found, coverage, n_changed): documents that hold at least
    ``share`` of an item's windows with consistently filled slots.

    ``n_changed`` counts the slot values that differ, zero for a verbatim leak. Items of equal
    texts are one item, the one with the smallest id. Null and empty texts, and those with fewer
    than five words, have no windows; so have stretches with too few literal words. ``row`` tells
    rows of one doc_id apart; equal rows give one result.
    """
    items = benchmark.groupBy(benchmark["text"]).agg(F.min(benchmark["item_id"]).alias("item_id"))
    in_item = Window.partitionBy("item").orderBy("n", "h", "ipos")
    bench = stored(template_windows(items, "item_id", "text"), "windows")
    counts = bench.groupBy("h").agg(F.count("*").alias("n"))
    bench = bench.join(counts, "h").select(
        "h", "n", F.col("id").alias("item"), F.col("pos").alias("ipos"), F.col("size").alias("isize"),
        F.col("slots").alias("islots"),
    )
    rare = F.col("isize") - F.ceil(F.lit(share) * F.col("isize")) + 1
    bench = stored(bench.withColumn("rare", F.row_number().over(in_item) <= rare), "ranked")
    seen = stored(
        template_windows(docs, id_col, text_col, _filter(bench)).drop("size"), "seen"
    )
    pairs = seen.join(bench.filter("rare").select("h", "item"), "h").select("id", "row", "item").distinct()
    s, p, b = seen.alias("s"), stored(pairs, "pairs").alias("p"), bench.alias("b")
    met = s.join(p, F.col("s.id").eqNullSafe(F.col("p.id")) & (F.col("s.row") == F.col("p.row"))).select(
        "s.*", "p.item"
    )
    met = met.join(b, ["item", "h"])
    slots = F.transform(F.arrays_zip("islots", "slots"), lambda x: F.struct(x["islots"], x["slots"]))
    aligned = met.groupBy("id", "row", "item", "isize", (F.col("pos") - F.col("ipos")).alias("diagonal")).agg(
        F.collect_set("ipos").alias("at"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("pairs")
    )
    left = F.array_distinct(F.transform("pairs", lambda x: x["islots"]))
    right = F.array_distinct(F.transform("pairs", lambda x: x["slots"]))
    one_to_one = (F.size("pairs") == F.size(left)) & (F.size("pairs") == F.size(right))
    changed = F.size(F.filter("pairs", lambda x: x["islots"] != x["slots"]))
    good = aligned.filter(one_to_one).select(
        "id", "row", "item", "isize", changed.alias("changed"), F.explode("at").alias("ipos")
    )
    best = good.groupBy("id", "row", "item", "isize", "ipos").agg(F.min("changed").alias("changed"))
    found = best.groupBy("id", "row", "item", "isize").agg(
        F.count("*").alias("n_found"), F.max("changed").cast("long").alias("n_changed")
    )
    return found.filter(F.col("n_found") >= F.ceil(F.lit(share) * F.col("isize"))).select(
        F.col("id").alias("doc_id"), "row", F.col("item").alias("item_id"),
        F.col("isize").cast("long").alias("n_windows"), "n_found",
        (F.col("n_found") / F.col("isize")).alias("coverage"), "n_changed",
    )


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")
