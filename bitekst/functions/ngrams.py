"""Clipped n-gram counts per row.

Counting needs nothing from other rows, so nothing crosses the network and ids need not be unique:
an Arrow function counts the rows of a batch, a part of it at once. The n-grams of all orders come
from one sort: a place of a text is the number made of its row, the next units and the side, and
places that agree in their first n units lie side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitekst.functions.scores import CHAR_ORDER, WORD_ORDER, token_list

# Units (words or characters) of both sides that are counted at once, so that memory does not follow
# the size of a batch; a longer row is counted alone.
UNITS = 1 << 15


def _parts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring rows with together at most about ``UNITS`` units."""
    group = (np.cumsum(sizes) - sizes) // UNITS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if a < b]


def _counts(
    units: np.ndarray, hyp_sizes: np.ndarray, ref_sizes: np.ndarray, orders: int
) -> np.ndarray:
    """matches, n-grams of the prediction and of the reference by row and order.

    ``units`` holds the numbers of the units of all predictions, then of all references.
    """
    rows = len(hyp_sizes)
    sizes = np.concatenate([hyp_sizes, ref_sizes])
    row_of = np.repeat(np.concatenate([np.arange(rows)] * 2), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(units))
    is_ref = (np.arange(len(units)) >= hyp_sizes.sum()).astype(np.uint64)
    out = np.zeros((3, orders, rows), np.int64)
    for n in range(1, orders + 1):
        out[1, n - 1] = np.maximum(hyp_sizes - n + 1, 0)
        out[2, n - 1] = np.maximum(ref_sizes - n + 1, 0)
    if not len(units):
        return out
    # 0 stands behind the last unit of a text.
    bits = int(units.max() + 1).bit_length()
    if orders * bits + rows.bit_length() + 1 <= 64:
        out[0] = _matches(units, left, row_of, is_ref, rows, orders, bits)
    else:
        out[0] = _matches_by_order(units, left, row_of, is_ref == 0, rows, orders)
    return out


def _matches(units, left, row_of, is_ref, rows: int, orders: int, bits: int) -> np.ndarray:
    size, width = len(units), np.uint64(bits)
    ahead = np.concatenate([units + 1, np.zeros(orders, np.int64)]).astype(np.uint64)
    key = row_of.astype(np.uint64)
    for n in range(orders):
        key = (key << width) | np.where(left > n, ahead[n : n + size], np.uint64(0))
    key = (key << np.uint64(1)) | is_ref
    key.sort()
    changed = key[1:] ^ key[:-1]
    refs = np.concatenate([[0], np.cumsum((key & np.uint64(1)).astype(np.int64))])
    unit = np.uint64((1 << bits) - 1)
    out = np.zeros((orders, rows), np.int64)
    for n in range(1, orders + 1):
        behind = np.uint64(1 + bits * (orders - n))
        first = np.concatenate([[0], np.flatnonzero(changed >> behind) + 1])
        ends = np.concatenate([first[1:], [size]])
        ref = refs[ends] - refs[first]
        both = np.minimum(ref, ends - first - ref)
        gram = key[first] >> behind
        (kept,) = np.nonzero((both > 0) & ((gram & unit) != 0))
        row = (gram[kept] >> np.uint64(bits * n)).astype(np.int64)
        out[n - 1] = np.bincount(row, weights=both[kept], minlength=rows)
    return out


def _matches_by_order(units, left, row_of, is_hyp, rows: int, orders: int) -> np.ndarray:
    """For places that fit no machine word: the n-grams of a row are numbered order by order; equal
    (row, n-gram of the order below, next unit) get the same number."""
    width = int(units.max()) + 1
    out = np.zeros((orders, rows), np.int64)
    at, gram = np.arange(len(units)), row_of
    for n in range(1, orders + 1):
        keep = left[at] >= n
        at, gram = at[keep], gram[keep]
        if not len(at):
            break
        _, first, gram = np.unique(
            gram * width + units[at + n - 1], return_index=True, return_inverse=True
        )
        hyp = np.bincount(gram[is_hyp[at]], minlength=len(first))
        ref = np.bincount(gram[~is_hyp[at]], minlength=len(first))
        np.add.at(out[n - 1], row_of[at[first]], np.minimum(hyp, ref))
    return out


def _struct(out: np.ndarray, kind: T.StructType) -> pa.StructArray:
    columns = out.reshape(len(kind), -1)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=kind.names)


def _schema(orders: int, prefix: str) -> T.StructType:
    sides = [f"{side}_{n}" for side in ("match", "hyp", "ref") for n in range(1, orders + 1)]
    return T.StructType([T.StructField(prefix + s, T.LongType()) for s in sides])


WORD_COUNTS, CHAR_COUNTS = _schema(WORD_ORDER, ""), _schema(CHAR_ORDER, "c_")


def _by_part(hyp: pa.Array, ref: pa.Array, orders: int, cut) -> np.ndarray:
    """The counts of all rows. ``cut`` turns texts into (numbers of all units, units of each text).
    A text has fewer units than bytes, or as many."""
    rough = [np.asarray(pc.binary_length(x)).astype(np.int64) for x in (hyp, ref)]
    out = np.zeros((3, orders, len(hyp)), np.int64)
    for a, b in _parts(rough[0] + rough[1]):
        units, sizes = cut(hyp[a:b].to_pylist() + ref[a:b].to_pylist())
        out[:, :, a:b] = _counts(units, sizes[: b - a], sizes[b - a :], orders)
    return out


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    split = [token_list(t) for t in texts]
    number: dict[str, int] = {}
    flat = [number.setdefault(w, len(number)) for ws in split for w in ws]
    return np.array(flat, np.int64), np.array([len(ws) for ws in split], np.int64)


def _chars(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    solid = ["".join(t.split()) for t in texts]
    codes = np.frombuffer("".join(solid).encode("utf-32-le", "surrogatepass"), np.uint32)
    there = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    there[codes] = 1
    return (np.cumsum(there) - 1)[codes], np.array([len(t) for t in solid], np.int64)


# Python splits at the characters of ``text.WHITESPACE``, too.
@F.arrow_udf(WORD_COUNTS)
def _word_counts(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    return _struct(_by_part(hyp, ref, WORD_ORDER, _words), WORD_COUNTS)


@F.arrow_udf(CHAR_COUNTS)
def _char_counts(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    return _struct(_by_part(hyp, ref, CHAR_ORDER, _chars), CHAR_COUNTS)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_counts(hyp: str, ref: str) -> Column:
    """Struct of word n-gram counts of orders 1..4: ``match_n``, ``hyp_n``, ``ref_n``."""
    return _word_counts(_text(hyp), _text(ref))


def char_counts(hyp: str, ref: str) -> Column:
    """Struct of character n-gram counts of orders 1..6 without whitespace: ``c_match_n``, …"""
    return _char_counts(_text(hyp), _text(ref))


def word_stats(
    df: DataFrame, row_id: str, hyp: str, ref: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One line per row with its word n-gram counts."""
    return df.select(row_id, *keep, word_counts(hyp, ref).alias("_w")).select(row_id, *keep, "_w.*")


def char_stats(
    df: DataFrame, row_id: str, hyp: str, ref: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One line per row with its character n-gram counts."""
    return df.select(row_id, *keep, char_counts(hyp, ref).alias("_c")).select(row_id, *keep, "_c.*")


def all_stats(
    df: DataFrame, row_id: str, hyp: str, ref: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Both kinds of counts in one pass."""
    both = [word_counts(hyp, ref).alias("_w"), char_counts(hyp, ref).alias("_c")]
    return df.select(row_id, *keep, *both).select(row_id, *keep, "_w.*", "_c.*")
