"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Candidates come from two sides. The SimHash of a text's shingles, linked through pivot distance tables
as in ``simhash``, gives the copies within three bits. It does not reach down to a similarity of 0.8:
two such texts differ in about ten of 64 bits, some in twenty, and no block of bits is left that they
surely share. So rows that agree in a band of their MinHash signature are candidates too, and every link
is verified by the exact similarity of the sets of shingles (as 64-bit hashes). Of the pairs at the limit
of 0.8 itself a share of (1 - 0.8^4)^32, 5 in 10^8, meet in no band; of closer ones fewer.

Before any text moves, candidates that cannot be so similar are left out, and no others: shingles are dealt
over 2048 places by their hash, and a row keeps one bit for each place, whether it has an odd number there.
Every bit in which two rows differ is a shingle that only one of them has, so more such bits than the
similarity allows shingles rule a pair out. What is left is verified on the stored arrays of shingle hashes.

Candidates are verified in three rounds: every row with a SimHash neighbour and with the first row of the
band that it shares most bands with, with the first rows of its other bands, and then with all rows of its
bands, and all that neighbouring SimHashes connect with it, that are not yet connected to it by links: the
first round sees a spanning forest of the SimHash neighbours and one row of each SimHash, the third all of
them. Pairs within one component need no look, so large groups
cost a few comparisons a row. In the third round a band's rows are dealt over pairs of blocks: a task
holds two blocks at a time, compares their rows as matrices and returns rows and links that join what was
apart, never pairs. Rows of a band that stay below the similarity are all compared, which is quadratic in
their number by nature; what moves is their number times that of the band's blocks, and nothing that
the bands offer is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitekst.llm import simhash
from bitekst.llm.common import by_batch, components, stored

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
BANDS, DEPTH = 32, 4
#: Places that shingles are dealt over, a power of two: one bit each.
PLACES = 2048
#: Shingles whose permuted hashes are held at a time.
SLICE = 512
#: Rows of a band that make a block of the third round.
BLOCK = 256


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted different XXH64 of the shingles of a text; of fewer words, of all of them; none without.

    ASCII letters are lower-cased, words are split at ASCII white space.
    """
    w = text.lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    parts = zip(*(w[i:] for i in range(size))) if len(w) >= size else [w]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, parts)), np.uint64))


def _bands(h: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """Hashes of the bands of the signature, one signed number each."""
    low = np.full(len(mul), np.iinfo(np.uint64).max)
    for i in range(0, len(h), SLICE):
        np.minimum(low, (mul[:, None] * h[None, i : i + SLICE] + add[:, None]).min(axis=1), out=low)
    rows = low.reshape(BANDS, DEPTH)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), seed=k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def odd_places(h: np.ndarray) -> bytes:
    """A bit for each place: whether an odd number of the hashes fall there."""
    place = (h % np.uint64(PLACES)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=PLACES) & 1 == 1).tobytes()


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shingles that at least only one of two rows has, by their bits of places (64 to a word)."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _may_reach(apart: np.ndarray, sizes: np.ndarray, similar: float) -> np.ndarray:
    """Whether rows of so many shingles in all may be so similar if so many are in one of them only; the
    small number is for the rounding of a pair at the limit."""
    return apart * (1 + similar) <= (1 - similar) * sizes + 1e-6


def signatures(docs: DataFrame, row: str, size: int = SHINGLE) -> DataFrame:
    """(doc_id, row, n, fp, h1, h2, bands, odd): number of different shingles, their SimHash, 128 bits
    of their set, the bands and the bits of places. A text without words has no bands."""

    def make():
        rng = np.random.default_rng(SEED)
        mul = rng.integers(0, 1 << 64, BANDS * DEPTH, np.uint64) | np.uint64(1)
        add = rng.integers(0, 1 << 64, BANDS * DEPTH, np.uint64)

        def run(b: dict) -> dict:
            n, fp, bands, odd, digests = [], [], [], [], []
            for text in b["text"]:
                h = shingles(text, size)
                n.append(len(h))
                fp.append(simhash.fingerprint(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                bands.append(_bands(h, mul, add).tolist() if len(h) else [])
                odd.append(odd_places(h))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            return {
                "doc_id": b["doc_id"], "row": b["row"], "n": n, "fp": fp, "bands": bands, "odd": odd,
                "h1": np.ascontiguousarray(halves[:, 0]), "h2": np.ascontiguousarray(halves[:, 1]),
            }

        return run

    texts = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs[row].alias("row"), docs["text"].cast("binary").alias("text")
    )
    schema = "doc_id long, row long, n int, fp long, h1 long, h2 long, bands array<long>, odd binary"
    return by_batch(texts, make, schema)


def likely(pairs: DataFrame, own: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) of nodes that may be so similar by their bits of places; none that are get lost."""

    def make():
        def run(b: dict) -> dict:
            x, y = (np.frombuffer(b"".join(b[k]), np.uint64).reshape(-1, PLACES // 64) for k in ("x", "y"))
            (good,) = _may_reach(_apart(x, y), np.array(b["sizes"], np.int64), similar).nonzero()
            return {k: np.array(b[k], np.int64)[good] for k in ("a", "b")}

        return run

    both = pairs.join(own.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("odd").alias("x")), "a")
    both = both.join(own.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("y")), "b")
    return by_batch(both.select("a", "b", (F.col("na") + F.col("nb")).alias("sizes"), "x", "y"), make, "a long, b long")


def _hashes(asked: DataFrame, docs: DataFrame, row: str, size: int) -> DataFrame:
    """(at, h): the arrays of shingle hashes of the row numbers ``at``, made once for every text."""

    def make():
        def run(b: dict) -> dict:
            return {"at": b["at"], "h": [shingles(t, size).tobytes() for t in b["t"]]}

        return run

    texts = docs.select(docs[row].alias("at"), docs["text"].cast("binary").alias("t"))
    return stored(by_batch(texts.join(asked.distinct(), "at", "left_semi"), make, "at long, h binary"), "hashes")


def verified(
    pairs: DataFrame, own: DataFrame, docs: DataFrame, row: str, similar: float = SIMILAR, size: int = SHINGLE
) -> DataFrame:
    """Those of the pairs (a, b) of row numbers whose texts are at least so similar: by bits of places
    first, then by the arrays of shingle hashes, made once for every text still in question."""
    pairs = stored(likely(pairs, own, similar), "likely")
    held = _hashes(pairs.select(F.explode(F.array("a", "b")).alias("at")), docs, row, size)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                one, other = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (x, y))
                both = len(np.intersect1d(one, other, assume_unique=True))
                good.append(both >= similar * (len(one) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(held.select(F.col("at").alias("a"), F.col("h").alias("x")), "a")
    both = both.join(held.select(F.col("at").alias("b"), F.col("h").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows (key, node, ...) of every band once for each pair of its blocks, ordered by (key, low, high)."""
    parts = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int")
    rows = rows.join(parts, "key").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("parts", "other")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, low, high), one pair of blocks at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("key", "low", "high")], axis=1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if held and tuple(at[i]) != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(i, j - i))
            last = tuple(at[i])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _near(t: pa.Table, similar: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, candidates, labels) for the rows i of one block: the rows of the other that have another label,
    bits of places and a size near enough, and no earlier band in common (no band, if a SimHash joins them)."""
    label, n, own, high = (t[k].to_numpy() for k in ("label", "n", "own", "high"))
    bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    odd = np.frombuffer(b"".join(t["odd"].to_pylist()), np.uint64).reshape(-1, PLACES // 64)
    number = next(iter(np.flatnonzero((bands == t["key"][0].as_py()).all(axis=0)).tolist()), BANDS)
    second = np.flatnonzero(own == high)
    alone = t["low"][0].as_py() == high[0]
    for k, i in enumerate(second if alone else np.flatnonzero(own != high)):
        j = second[k + 1 :] if alone else second
        j = j[label[j] != label[i]]
        j = j[np.minimum(n[j], n[i]) >= similar * np.maximum(n[j], n[i])]
        j = j[_may_reach(_apart(odd[j], odd[i]), n[j].astype(np.int64) + n[i], similar)]
        j = j[~(bands[j, :number] == bands[i, :number]).any(axis=1)]
        if len(j):
            yield int(i), j, label


def _asked(placed: DataFrame, similar: float) -> DataFrame:
    """(key, node): the rows (key, label, node, n, bands, odd) that have a candidate in their band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            found = [x for i, j, _ in _near(t, similar) for x in (i, *j)]
            if found:
                yield from t.select(["key", "node"]).take(np.unique(found)).to_batches()

    return _dealt(placed).mapInArrow(run, "key long, node long").distinct()


def _joining(placed: DataFrame, similar: float) -> DataFrame:
    """(a, b): links between the rows (key, label, node, n, bands, odd, h) of a band that join all of its
    labels that links join; every pair of blocks returns a spanning forest of them."""

    def linked(t: pa.Table) -> tuple[list[int], list[int]]:
        h = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["h"]]
        node, left, right = t["node"].to_pylist(), [], []
        known: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := known.get(x, x)) != x:
                known[x] = x = known.get(up, up)
            return x

        for i, near, label in _near(t, similar):
            near = [j for j in near.tolist() if root(int(label[j])) != root(int(label[i]))]
            if not near:
                continue
            sizes = np.array([len(h[j]) for j in near])
            them = np.concatenate([h[j] for j in near])
            hit = h[i][np.minimum(np.searchsorted(h[i], them), len(h[i]) - 1)] == them
            both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
            for j in np.array(near)[both >= similar * (len(h[i]) + sizes - both)].tolist():
                x, y = root(int(label[i])), root(int(label[j]))
                if x != y:
                    known[x] = y
                    left.append(node[i])
                    right.append(node[j])
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for t in _groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in linked(t)], schema=schema)

    return _dealt(placed).mapInArrow(run, "a long, b long").distinct()


def _fingerprints(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, top), the first class of every SimHash, and (a, b), the links of neighbouring SimHashes."""
    tops = stored(classes.filter("n > 0").groupBy("fp").agg(F.min("node").alias("top")), "fingerprints")
    return tops, stored(simhash.links(tops.select("fp")), "bits")


def _neighbours(classes: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(a, b): the classes of one SimHash with their first, and the first ones of linked SimHashes."""
    tops, link = found or _fingerprints(classes)
    same = classes.filter("n > 0").join(tops, "fp").filter("node > top").select(F.col("top").alias("a"), F.col("node").alias("b"))
    link = link.join(tops.select(F.col("fp").alias("a"), F.col("top").alias("x")), "a")
    link = link.join(tops.select(F.col("fp").alias("b"), F.col("top").alias("y")), "b")
    return same.unionByName(link.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def _alike(classes: DataFrame, link: DataFrame) -> DataFrame:
    """(key, node, n): the classes that neighbouring SimHashes connect, if there are several; all pairs of
    them hold all neighbours, of which the links are a spanning forest only."""
    label = components(link)
    rows = classes.filter("n > 0").join(label.withColumnRenamed("node", "fp"), "fp", "left")
    rows = rows.select(F.xxhash64(F.lit("simhash"), F.coalesce("label", "fp")).alias("key"), "node", "n")
    several = rows.groupBy("key").count().filter("count > 1").select("key")
    return rows.join(several, "key", "left_semi")


def _label(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (node, ...) with the label of their component."""
    label = components(links).withColumnRenamed("node", "at")
    return nodes.join(label, nodes["node"] == label["at"], "left").select(
        *nodes.columns, F.coalesce("label", "node").alias("label")
    )


def near_duplicates(docs: DataFrame, row: str, similar: float = SIMILAR, size: int = SHINGLE) -> DataFrame:
    """(doc_id, row, component_id, stays), one row per row of ``docs``, a stored table that numbers its
    rows in the column ``row``.

    Documents are linked if the Jaccard similarity of their shingles of ``size`` words is at least
    ``similar``; ``component_id`` is the smallest doc_id reachable over links. ``stays`` marks one
    row of each component: the first by doc_id (null last), then row. Texts of equal shingles are
    one class before anything is compared; texts without words are one class.
    """
    marked = stored(signatures(docs, row, size), "signatures")
    head = F.struct(F.isnull("doc_id").alias("null"), "doc_id", "row")
    classes = stored(
        marked.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("first"), F.min(head).alias("head"), F.min("row").alias("node"),
            F.first("fp").alias("fp"), F.first("n").alias("n"),
        ),
        "classes",
    )
    keyed = marked.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    keyed = keyed.select(F.col("row").alias("node"), "n", F.explode("bands").alias("key"))
    own = marked.select(F.col("row").alias("node"), "n", "odd", "bands")
    shared = stored(
        keyed.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.struct("node", "n")).alias("top")).filter("rows > 1"),
        "bands",
    )
    keyed = stored(keyed.join(shared, "key").select("key", "node", "n", "top"), "banded")
    sizes = lambda a, b: (F.least(a, b) >= F.lit(similar) * F.greatest(a, b))
    stars = stored(
        keyed.filter(F.col("node") != F.col("top.node")).filter(sizes(F.col("n"), F.col("top.n")))
        .groupBy(F.col("top.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("met")),
        "stars",
    )
    best = stars.groupBy("b").agg(F.max(F.struct("met", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    found = _fingerprints(classes)
    best = stored(best.unionByName(_neighbours(classes, found)).distinct(), "best")
    links = stored(verified(best, own, docs, row, similar, size), "links")

    def apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
        """Pairs of nodes that are not connected yet."""
        label = stored(components(links), "labels")
        x = label.select(F.col("node").alias("a"), F.col("label").alias("la"))
        y = label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        pairs = pairs.join(x, "a", "left").join(y, "b", "left")
        return pairs.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    rest = stored(apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), links), "rest")
    links = links.unionByName(stored(verified(rest, own, docs, row, similar, size), "links"))

    # all pairs of a band or of connected SimHashes that no links connect: in blocks, those that may be near by their texts
    keyed = keyed.select("key", "node", "n").unionByName(_alike(classes, found[1]))
    placed = stored(_label(keyed, links), "placed")
    parts = placed.groupBy("key", "label").agg(F.count("*").alias("rows"))
    several = parts.groupBy("key").agg(F.count("*").alias("labels")).filter("labels > 1").select("key")
    placed = stored(placed.join(several, "key", "left_semi"), "apart")
    own = own.drop("n")
    asked = stored(_asked(placed.join(own, "node"), similar), "asked")
    held = _hashes(asked.select(F.col("node").alias("at")), docs, row, size).withColumnRenamed("at", "node")
    placed = placed.join(asked, ["key", "node"]).join(own, "node").join(held, "node")
    links = links.unionByName(stored(_joining(placed, similar), "links"))

    found = stored(_label(classes, links), "labelled")
    least = found.groupBy("label").agg(F.min("first").alias("component_id"), F.min("head").alias("kept"))
    named = found.select("h1", "h2", "label").join(stored(least, "least"), "label")
    named = stored(named.select("h1", "h2", "component_id", F.col("kept.row").alias("first_row")), "components")
    return marked.select("doc_id", "row", "h1", "h2").join(named, ["h1", "h2"]).select(
        "doc_id", "row", "component_id", (F.col("row") == F.col("first_row")).alias("stays")
    )
