"""Exact top-k by inner product with a dual traversal of cover trees.

Data and queries are indexed together: a bounded sample gives centres, every vector belongs to the
cell of its nearest centre, and a cell's covering radius is the largest distance in it. For a query
group with centre ``a`` and radius ``r`` and a data node with centre ``b`` and radius ``s`` no inner
product exceeds ``a.b + r|b| + s|a| + rs``; where this is below the worst k-th score of the group,
the pair of nodes is pruned. First whole cells are pruned with k-th scores from the sample; in the
tasks, trees over a block of a cell and over the queries that need it are traversed together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitekst.llm.common import stored

TOP, SCALE, EVERY = 5, 256, 50
#: Vectors in the sample that gives centres and first k-th scores; cells; vectors of a block of a
#: cell; queries that share a task; points of a leaf.
SAMPLE, CELLS, BLOCK, QUERIES, LEAF = 2048, 32, 8192, 65536, 256
#: Most children of a node.
FAN = 8
EXACT = 2.0**52


def scaled(embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of the integers floor(scale * x) as doubles. A vector that is null or
    has a component that is null or not finite is left out."""
    x = embeddings.select(
        embeddings[id_col].cast("long").alias("vec_id"), embeddings[vector].cast("array<double>").alias("v")
    )
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    whole = x.filter("v is not null").filter(~F.exists("v", bad))
    # doubles from 2^53 on are whole already, and too large for the longs that floor() gives
    floor = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)
    return whole.select("vec_id", F.transform("v", lambda e: floor(e * scale)).alias("v"))


def inner(a: np.ndarray, b: np.ndarray, small: bool | None = None) -> np.ndarray:
    """Exact inner products of integer vectors held as doubles, as 64-bit numbers; those beyond
    their range become the nearest 64-bit number. ``small`` tells that doubles hold all sums."""
    if fits(a, b) if small is None else small:
        return (a @ b.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


def fits(a: np.ndarray, b: np.ndarray) -> bool:
    return np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] <= EXACT


class Node:
    __slots__ = ("center", "radius", "norm", "rows", "children")

    def __init__(self, center, radius, rows, children):
        self.center, self.radius, self.norm = center, radius, float(np.linalg.norm(center))
        self.rows, self.children = rows, children


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Node:
    """A cover tree: the points of a node lie within its radius of its centre. Its children's
    centres are points of it, each the furthest from those before, until they cover the node with
    half its radius or ``FAN`` are chosen; every point goes to the nearest. So centres lie apart,
    and each level covers more closely. A node with few points, or none apart, is a leaf."""

    def build(rows: np.ndarray) -> Node:
        own = points[rows]
        middle = ((own - own.mean(axis=0)) ** 2).sum(axis=1).argmin()
        distance = ((own - own[middle]) ** 2).sum(axis=1)
        radius = float(np.sqrt(distance.max()))
        if len(rows) <= leaf or radius == 0.0:
            return Node(own[middle], radius, rows, ())
        nearest, cell = distance, np.zeros(len(rows), np.int64)
        for i in range(1, FAN):
            if nearest.max() <= (radius / 2) ** 2:
                break
            d = ((own - own[nearest.argmax()]) ** 2).sum(axis=1)
            cell[d < nearest] = i
            nearest = np.minimum(nearest, d)
        parts = (rows[cell == i] for i in np.unique(cell))
        return Node(own[middle], radius, rows, tuple(map(build, parts)))

    return build(np.arange(len(points)))


def bound(q: Node, p: Node) -> float:
    """No inner product of a point of one node with one of the other is larger (with a margin for
    rounding)."""
    value = float(q.center @ p.center) + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius
    return value + 1e-9 * (abs(value) + (q.norm + q.radius) * (p.norm + p.radius)) + 1e-6


class Best:
    """The k best scores of every query so far, ties to the smaller id (null last).

    Scores that may be among them are gathered and settled from time to time; ``worst`` is a score
    that the k-th of a query reaches.
    """

    def __init__(self, n: int, k: int, start: np.ndarray):
        self.n, self.k, self.worst = n, k, start.copy()
        self.held = [(np.zeros(0, np.int64),) * 3]
        self.size, self.limit = 0, max(1 << 16, 8 * n * k)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        i, j = np.nonzero(ok & (scores >= self.worst[rows][:, None]))
        self.held.append((rows[i], scores[i, j], ids[j]))
        self.size += len(i)
        if self.size > self.limit:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """(query row, score, id) of the k best, by query."""
        row, score, who = (np.concatenate(c) for c in zip(*self.held))
        # the complement of a 64-bit number turns the order around without overflow
        order = np.lexsort((who, ~score, row))
        row, score, who = row[order], score[order], who[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kth = place == self.k - 1
        reached = score[kth].astype(np.float64)
        self.worst[row[kth]] = np.maximum(self.worst[row[kth]], reached - np.abs(reached) * 1e-15)
        keep = place < self.k
        self.held, self.size = [(row[keep], score[keep], who[keep])], int(keep.sum())
        return self.held[0]


def dual_search(
    queries: np.ndarray, query_ids: np.ndarray, start: np.ndarray,
    data: np.ndarray, data_ids: np.ndarray, tree: Node, k: int,
) -> tuple[np.ndarray, ...]:
    """(query row, score, id) of the k best of ``data`` for every query; ``start`` holds scores that
    a k-th reaches anyway."""
    best = Best(len(queries), k, start)
    small = fits(queries, data)
    stack = [(cover_tree(queries), tree)]
    while stack:
        q, p = stack.pop()
        if bound(q, p) < best.worst[q.rows].min():
            continue
        if not q.children and not p.children:
            scores = inner(queries[q.rows], data[p.rows], small)
            ok = query_ids[q.rows][:, None] != data_ids[p.rows][None, :]
            best.add(q.rows, scores, data_ids[p.rows], ok)
            continue
        # the wider node is opened; the most promising pairs are looked at first
        if q.children and (not p.children or q.radius >= p.radius):
            pairs = [(c, p) for c in q.children]
        else:
            pairs = [(q, c) for c in p.children]
        stack += sorted(pairs, key=lambda x: bound(*x))
    return best.settle()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, shorter ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def top_k(embeddings: DataFrame, is_query, k: int = TOP, id_col: str = "vec_id", vector: str = "embedding",
          sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product for every query.

    ``is_query`` is a condition on ``vec_id``. Candidates are all rows with another id than the
    query; ties go to the smaller id, a null id comes last and is no query. Rows of one id
    are candidates each; as a query an id has its smallest vector. A query with fewer candidates gets all. Shorter vectors count as filled up with zeros. Vectors
    that are null or hold null or non-finite components take no part.
    """
    data = stored(scaled(embeddings, id_col, vector), "vectors")
    h = F.xxhash64("v", "vec_id")
    drawn = data.orderBy(h, "vec_id").limit(sample).collect()
    if not drawn:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, n = data.agg(F.max(F.size("v")), F.count("*")).first()
    points = np.zeros((len(drawn), width))
    for i, r in enumerate(drawn):
        points[i, : len(r["v"])] = r["v"]
    ids = np.array([-1 if r["vec_id"] is None else r["vec_id"] for r in drawn])
    chosen, distance = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(CELLS, len(points)) and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    centers = points[chosen]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1), width)
                d = (m**2).sum(axis=1)[:, None] - 2 * m @ centers.T + (centers**2).sum(axis=1)[None, :]
                cell = d.argmin(axis=1)
                far = np.sqrt(((m - centers[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(far)],
                    names=["vec_id", "v", "cell", "far"],
                )

    placed = data.mapInArrow(assign, "vec_id long, v array<double>, cell int, far double")
    cells = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    used = sorted(cells)
    blocks = {c: -(-cells[c]["n"] // block) for c in used}
    query = placed.filter(is_query).filter("vec_id is not null")
    query = query.groupBy("vec_id").agg(F.min(F.struct("v", "cell", "far")).alias("q")).select("vec_id", "q.*")
    many = query.count()
    splits = max(1, -(-many // QUERIES))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every query and block of a cell that is not pruned, with the score that the
        query's k-th reaches on the sample."""
        center, far = centers[used], np.array([cells[c]["far"] for c in used])
        reach = np.linalg.norm(center, axis=1)
        for b in batches:
            if not b.num_rows:
                continue
            who, m = b.column(0).to_numpy(), _matrix(b.column(1), width)
            scores = inner(m, points).astype(np.float64)
            scores[who[:, None] == ids[None, :]] = -np.inf
            kth = np.sort(scores, axis=1)[:, -k] if len(points) >= k else np.full(len(m), -np.inf)
            kth = np.where(np.isfinite(kth), kth - np.abs(kth) * 1e-9 - 1e-6, -np.inf)
            norm = np.linalg.norm(m, axis=1)
            upper = m @ center.T + norm[:, None] * far[None, :]
            upper += 1e-9 * (np.abs(upper) + norm[:, None] * (reach + far)[None, :]) + 1e-6
            row, cell = np.nonzero(upper >= kth[:, None])
            copies = np.array([blocks[c] for c in used])[cell]
            row, cell = np.repeat(row, copies), np.repeat(cell, copies)
            number = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(used, np.int32)[cell]), pa.array(number.astype(np.int32)),
                    pa.array((np.abs(who[row]) // 7919 % splits).astype(np.int32)), pa.array(np.ones(len(row), np.int8)),
                    b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(kth[row]),
                    b.column(2).take(pa.array(row)),
                ],
                names=["cell", "block", "split", "side", "vec_id", "v", "kth", "home"],
            )

    schema = "cell int, block int, split int, side byte, vec_id long, v array<double>, kth double, home int"
    asked = query.mapInArrow(route, schema)
    per_cell = F.create_map(*[F.lit(x) for c in used for x in (c, blocks[c])])
    rows = placed.select(
        "cell", F.pmod(F.xxhash64("vec_id", "v"), per_cell[F.col("cell")]).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(0).cast("byte").alias("side"),
        "vec_id", "v", F.lit(0.0).alias("kth"), F.col("cell").alias("home"),
    )
    keys = ["cell", "block", "split"]
    n_parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.unionByName(asked).repartition(n_parts, *keys).sortWithinPartitions(*keys, "side", "home")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block: its data first, of which a tree is made; then its queries, as they come."""
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        key, gathered, tree, data, data_ids = None, [], None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1, [len(codes)]])
            for i, j in zip(cut[:-1], cut[1:]):
                part, at = b.slice(i, j - i), tuple(codes[i, :3])
                if at != key:
                    key, gathered, tree = at, [], None
                vec = _matrix(part.column(5), width)
                if codes[i, 3] == 0:
                    who = part.column(4).fill_null(np.iinfo(np.int64).max).to_numpy()
                    gathered.append((vec, who))
                    continue
                if not gathered and tree is None:
                    continue
                if tree is None:
                    data, data_ids = (np.concatenate(c) for c in zip(*gathered))
                    tree, gathered = cover_tree(data), []
                who = part.column(4).to_numpy()
                row, score, found = dual_search(vec, who, part.column(6).to_numpy(), data, data_ids, tree, k)
                nobody = found == np.iinfo(np.int64).max
                columns = [pa.array(who[row]), pa.array(found, mask=nobody), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of all embeddings for every row whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % EVERY == 0)
