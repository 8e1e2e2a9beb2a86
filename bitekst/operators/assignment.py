"""Best one-to-one assignment of a document's sentences: the largest total similarity.

Every sentence of the smaller side gets a partner, as the whole matrix counts; pairs below the
threshold are dropped afterwards. Documents whose matrix is small are solved exactly, one in a task at
a time. Longer ones go through an auction over all tasks: sentences without a partner bid for the one
they gain most by, prices are kept in a table, the highest bid takes a partner, and matrices are only
looked at in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitekst.functions.vectors import cosine
from bitekst.operators.alignment import BLOCK, THRESHOLD, of_side, texts
from bitekst.session import materialize

# A document is solved in one task up to so many sentences and cells of its matrix.
TASK_SENTENCES, TASK_CELLS = 4096, 1 << 20
# A bid is higher than the last price by this at least; a total is at most this much a pair below the best.
EPSILON = 1e-3

_PAIRS = "doc_id long, en_pos long, no_pos long, similarity double"
_OFFERS = "doc_id long, pos long, other long, value double, second double, price double"


def similarities(a, b) -> np.ndarray:
    """Cosines of all pairs of rows; 0 for a vector of zeros."""
    sides = []
    for v in (a, b):
        v = np.stack([np.asarray(x, dtype=float) for x in v])
        lengths = np.linalg.norm(v, axis=1, keepdims=True)
        sides.append(v / np.where(lengths > 0, lengths, 1.0))
    return np.round(sides[0] @ sides[1].T, 12)


def assign(value: np.ndarray) -> np.ndarray:
    """For each row the column that gives the largest total; there must not be more rows than columns.

    Rows come in one by one; each finds the cheapest way of exchanging columns with those before,
    by shortest paths over reduced costs, all columns at a time.
    """
    rows, columns = value.shape
    of_row, of_column = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for new in range(rows):
        dist, via = np.full(columns, np.inf), np.full(columns, -1)
        done = np.zeros(columns, dtype=bool)
        row, last, length = new, -1, 0.0
        while True:
            reach = length - value[row] - of_row[row] - of_column
            better = ~done & (reach < dist)
            dist[better], via[better] = reach[better], last
            last = int(np.where(done, np.inf, dist).argmin())
            length, done[last] = dist[last], True
            if owner[last] < 0:
                break
            row = owner[last]
        of_row[new] += length
        for column in np.flatnonzero(done):
            if column != last and owner[column] >= 0:
                of_row[owner[column]] += length - dist[column]
            of_column[column] -= length - dist[column]
        while last >= 0:
            before = via[last]
            owner[last] = owner[before] if before >= 0 else new
            last = before
    out = np.empty(rows, dtype=np.int64)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def _solve_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            en, no = np.asarray(row.en_pos), np.asarray(row.no_pos)
            value = similarities(row.en_v, row.no_v)
            if len(en) <= len(no):
                i, j = np.arange(len(en)), assign(value)
            else:
                i, j = assign(value.T), np.arange(len(no))
            yield pd.DataFrame({"doc_id": row.doc_id, "en_pos": en[i], "no_pos": no[j], "similarity": value[i, j]})


def best_in_tasks(sentences: DataFrame) -> DataFrame:
    """(doc_id, en_pos, no_pos, similarity): the best assignment of documents that fit a task."""

    def side(name: str) -> DataFrame:
        s = sentences.filter(F.col("side") == name).groupBy("doc_id").agg(
            F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("s")
        )
        return s.select("doc_id", F.col("s.pos").alias(f"{name}_pos"), F.col("s.v").alias(f"{name}_v"))

    return side("en").join(side("no"), "doc_id").mapInPandas(_solve_documents, _PAIRS)


def _block_offers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best gain and second best of every bidder inside one pair of blocks."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            price = np.asarray(row.price)
            gain = similarities(row.bid_v, row.v) - price
            order = np.lexsort((np.broadcast_to(row.other, gain.shape), -gain))
            first = order[:, 0]
            lines = np.arange(len(gain))
            second = gain[lines, order[:, 1]] if gain.shape[1] > 1 else pd.array([None] * len(gain), "Float64")
            yield pd.DataFrame(
                {
                    "doc_id": row.doc_id,
                    "pos": row.bid_pos,
                    "other": np.asarray(row.other)[first],
                    "value": gain[lines, first],
                    "second": second,
                    "price": price[first],
                }
            )


def _blocks(rows: DataFrame, block: int, names: dict[str, str]) -> DataFrame:
    """Rows of a document in blocks of positions, columns as arrays under other names."""
    taken = F.sort_array(F.collect_list(F.struct(*names)))
    by_block = rows.groupBy("doc_id", F.floor(F.col("pos") / block).alias("block")).agg(taken.alias("s"))
    return by_block.select("doc_id", "block", *[F.col(f"s.{c}").alias(n) for c, n in names.items()])


def _offers(free: DataFrame, goods: DataFrame, block: int) -> DataFrame:
    """(doc_id, pos, other, bid): what every free sentence bids, and for which partner.

    A bid leaves the bidder as content with this partner as with the second best one.
    """
    bidders = _blocks(free, block, {"pos": "bid_pos", "v": "bid_v"}).withColumnRenamed("block", "bid_block")
    offered = _blocks(goods, block, {"pos": "other", "v": "v", "price": "price"})

    def places(blocks: DataFrame, name: str) -> DataFrame:
        return blocks.groupBy("doc_id").agg(F.collect_list(name).alias("places"))

    # Every pair of blocks is a key, so a long document spreads over the tasks.
    left = bidders.join(places(offered, "block"), "doc_id").withColumn("block", F.explode("places")).drop("places")
    right = offered.join(places(bidders, "bid_block"), "doc_id").withColumn("bid_block", F.explode("places")).drop("places")
    met = left.join(right, ["doc_id", "bid_block", "block"]).drop("bid_block", "block")
    rated = met.mapInPandas(_block_offers, _OFFERS)
    best = F.max(F.struct(F.col("value"), -F.col("other"), F.col("price"))).alias("best")
    # A block of one partner has no second best gain: null.
    gains = F.sort_array(F.flatten(F.collect_list(F.array("value", "second"))), asc=False)
    top = rated.groupBy("doc_id", "pos").agg(best, F.get(gains, F.lit(1)).alias("second"))
    value, price = F.col("best.value"), F.col("best.price")
    return top.select(
        "doc_id", "pos", (-F.col("best.col2")).alias("other"), (price + value - F.coalesce("second", value)).alias("bid")
    )


def auction(bidders: DataFrame, goods: DataFrame, epsilon: float = EPSILON, block: int = BLOCK) -> DataFrame:
    """(doc_id, pos, other): every bidder with its partner; both tables are (doc_id, pos, v), and no
    document may have more bidders than goods.

    Prices begin at zero and rise by ``epsilon`` at least with every bid, and a partner that has been
    bid for stays taken; so partners without a bid cost nothing, which makes the result the best but
    for ``epsilon`` a pair. Similarities differ by 2 at most: no price rises above 2 + epsilon while
    anything is free, and a document of n bidders takes n · (2 / epsilon + 1) rounds at the very
    most; usually it is a few dozen, since all free sentences bid at once. Between rounds only
    (doc_id, pos, price, owner) is written down.
    """
    state = materialize(goods.select("doc_id", "pos", F.lit(0.0).alias("price"), F.lit(None).cast("long").alias("owner")))
    while True:
        owned = state.filter("owner is not null").select("doc_id", F.col("owner").alias("pos"))
        free = materialize(bidders.join(owned, ["doc_id", "pos"], "left_anti"))
        if free.isEmpty():
            break
        open_ = free.select("doc_id").distinct()
        priced = goods.join(open_, "doc_id", "left_semi").join(state.select("doc_id", "pos", "price"), ["doc_id", "pos"])
        won = _offers(free, priced, block).groupBy("doc_id", F.col("other").alias("pos")).agg(
            F.max(F.struct(F.col("bid"), -F.col("pos"))).alias("w")
        )
        won = won.select("doc_id", "pos", F.col("w.bid").alias("bid"), (-F.col("w.col2")).alias("winner"))
        state = materialize(
            state.join(won, ["doc_id", "pos"], "left").select(
                "doc_id",
                "pos",
                F.coalesce(F.col("bid") + epsilon, "price").alias("price"),
                F.coalesce("winner", "owner").alias("owner"),
            )
        )
    return state.filter("owner is not null").select("doc_id", F.col("owner").alias("pos"), F.col("pos").alias("other"))


def best_by_auction(sentences: DataFrame, epsilon: float = EPSILON, block: int = BLOCK) -> DataFrame:
    """(doc_id, en_pos, no_pos, similarity): assignment of documents of any length; the side with
    fewer sentences bids."""
    size = sentences.groupBy("doc_id").agg(
        F.count_if(F.col("side") == "en").alias("n_en"), F.count_if(F.col("side") == "no").alias("n_no")
    )
    fewer = size.filter("n_en > 0 and n_no > 0").select(
        "doc_id", F.when(F.col("n_en") <= F.col("n_no"), "en").otherwise("no").alias("bids")
    )
    rows = materialize(sentences.select("doc_id", "side", "pos", "v").join(fewer, "doc_id"))
    bidders = rows.filter("side = bids").select("doc_id", "pos", "v", "side")
    goods = rows.filter("side <> bids").select("doc_id", "pos", "v")
    taken = auction(bidders.drop("side"), goods, epsilon, block)
    pairs = bidders.withColumnRenamed("v", "a").join(taken, ["doc_id", "pos"]).join(
        goods.select("doc_id", F.col("pos").alias("other"), F.col("v").alias("b")), ["doc_id", "other"]
    )
    is_en = F.col("side") == "en"
    return pairs.select(
        "doc_id",
        F.when(is_en, F.col("pos")).otherwise(F.col("other")).alias("en_pos"),
        F.when(is_en, F.col("other")).otherwise(F.col("pos")).alias("no_pos"),
        F.coalesce(cosine(F.col("a"), F.col("b")), F.lit(0.0)).alias("similarity"),
    )


def align_assignment(
    sentences: DataFrame,
    threshold: float = THRESHOLD,
    epsilon: float = EPSILON,
    task_sentences: int = TASK_SENTENCES,
    task_cells: int = TASK_CELLS,
) -> DataFrame:
    """The pairs of the best assignment that reach the threshold.

    Exact for documents of up to ``task_sentences`` sentences and ``task_cells`` pairs, else within
    ``epsilon`` a pair. Which of several best assignments is found follows positions.
    """
    size = sentences.groupBy("doc_id").agg(
        F.count_if(F.col("side") == "en").alias("n_en"), F.count_if(F.col("side") == "no").alias("n_no")
    )
    fits = (F.col("n_en") + F.col("n_no") <= task_sentences) & (F.col("n_en") * F.col("n_no") <= task_cells)
    size = materialize(size.select("doc_id", fits.alias("fits")))
    marked = sentences.join(size, "doc_id")
    pairs = best_in_tasks(marked.filter("fits"))
    if not size.filter("not fits").isEmpty():
        pairs = pairs.unionByName(best_by_auction(marked.filter("not fits"), epsilon))
    good = pairs.filter(F.col("similarity") >= threshold)
    if texts(sentences):
        good = good.join(of_side(sentences, "en", "en_pos"), ["doc_id", "en_pos"])
        good = good.join(of_side(sentences, "no", "no_pos"), ["doc_id", "no_pos"])
    return good.select(
        "doc_id", "en_pos", "no_pos", *texts(sentences), "similarity", F.lit("assignment").alias("method")
    )
