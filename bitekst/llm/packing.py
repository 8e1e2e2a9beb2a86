"""Mixture-controlled packing of documents into sequences of equal length.

Every source is a queue of documents, cut into packets of at most ``packet`` tokens. Deficit
round-robin serves the queues: in every round a queue's credit grows by its quantum (its target
share of one sequence), and it sends the packets that its credit covers; the rest of the credit,
its deficit, is carried on. A packet that ends ``e`` tokens into its queue is therefore sent in
round ``ceil(e / quantum)``, which needs no state: prefix sums give ``e``, and the order (round,
source, place in the queue) gives the stream that is cut into full sequences. Deficits so reach
over sequences and over Spark partitions alike. When a queue runs dry, the others share its place.

Prefix sums are taken inside chunks of bounded size, with the sums of the chunks before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitekst.llm.common import stored

LENGTH, PACKET, END = 2048, 512, 1
#: Rounds whose packets are ordered in one task.
ROUNDS = 1024
#: Bytes of text handled at once, and pieces of text remembered by a task.
BYTES, KNOWN = 1 << 21, 600_000
#: How the supported byte-level vocabularies split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_units() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: those that are printable
    themselves as they are, the others in order from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_encoder(spec: str):
    """(text → ids, whether texts may be cut at lone blanks) for the text of a tokenizer file.

    If the file is a byte-level vocabulary whose ids follow its merges, the same ids come faster
    from a table of ranks; else the tokenizer itself encodes.
    """
    import tiktoken
    from tokenizers import Tokenizer

    d = json.loads(spec)
    model, pre = d["model"], d.get("pre_tokenizer") or {}
    byte_level = (
        pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        and not d.get("normalizer") and model.get("type") == "BPE"
        and not model.get("dropout") and not model.get("ignore_merges")
    )
    if byte_level:
        special = {t["content"] for t in d.get("added_tokens", [])}
        units, vocab = _byte_units(), model["vocab"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        plain = {k: v for k, v in vocab.items() if k not in special}
        if all(vocab[m] == 256 + i for i, m in enumerate(merged)) and len(plain) == 256 + len(merged):
            ranks = {bytes(units[c] for c in k): v for k, v in plain.items()}
            encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            return encoding.encode_ordinary, True
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids, False


class Encoder:
    """Encodes many texts at once: cuts them into pieces whose ids do not depend on what stands
    around, finds the different pieces by a 128-bit hash, and encodes only those not yet known."""

    def __init__(self, spec: str):
        self.encode, self.cuttable = plain_encoder(spec)
        powers = np.cumprod(np.full((2, BYTES + 1), [[0x9E3779B97F4A7C15], [0xD6E8FEB86659FD93]], np.uint64), axis=1)
        inverse = np.array([[pow(x, -1, 1 << 64)] for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)], np.uint64)
        self.powers = powers
        self.back = np.cumprod(np.broadcast_to(inverse, powers.shape), axis=1)
        # classes of bytes: blank, other white space, letter, mark, unclear next to a blank
        self.kind = np.zeros(256, np.uint8)
        self.kind[9:14] = 2
        self.kind[32] = 1
        for b in range(33, 127):
            self.kind[b] = 3 if chr(b).isalpha() else 4 if not chr(b).isalnum() and b != 39 else 0
        self.before = self.kind.copy()  # of the byte before a blank: it may end a wide blank
        self.after = self.kind.copy()  # of the byte behind: it may begin one
        self.before[28:32] = self.after[28:32] = 2
        self.before[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = 2
        self.after[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.at, self.count, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.store, self.used = np.zeros(1 << 18, np.uint32), 0

    def _add(self, ids: list[int]) -> int:
        if self.size == len(self.at):
            self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count))
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.at[self.size], self.count[self.size] = self.used, len(ids)
        self.store[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.size += 1
        return self.size - 1

    def _cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where pieces begin: at a text, at a lone blank, around another lone white space, and
        between a letter and a mark."""
        kind = self.kind[raw]
        before = np.concatenate([[2], self.before[raw[:-1]]])
        after = np.concatenate([self.after[raw[1:]], [2]])
        edge = np.zeros(len(raw) + 1, bool)
        edge[starts] = True
        # white space at the rim of a text stands with a neighbour that is not there
        rim = edge[:-1] | edge[1:]
        rim[-1] = True
        lone = (before != 1) & (before != 2) & (after != 1) & (after != 2) & ~rim
        blank, white = lone & (kind == 1), lone & (kind == 2)
        cut = edge[:-1]
        cut |= blank | white
        cut[1:] |= white[:-1]
        cut[1:] |= (kind[:-1] == 3) & (kind[1:] == 4)
        return np.flatnonzero(cut)

    def _few(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids by text) of texts that fit the tables."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        if self.size > KNOWN:
            self.clear()
        first = self._cuts(raw, starts)
        end = np.concatenate([first[1:], [len(raw)]])
        sums = np.zeros((2, len(raw) + 1), np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[:, : len(raw)], axis=1, out=sums[:, 1:])
        h, check = (sums[:, end] - sums[:, first]) * self.back[:, first]
        _, where, of = np.unique(h, return_index=True, return_inverse=True)
        whole = raw.tobytes()
        slot = np.empty(len(where), np.int64)
        for k, (i, a, b, key) in enumerate(
            zip(where.tolist(), first[where].tolist(), end[where].tolist(), zip(h[where].tolist(), check[where].tolist()))
        ):
            s = self.slots.get(key)
            if s is None:
                s = self.slots[key] = self._add(self.encode(whole[a:b].decode("utf-8", "replace")))
            slot[k] = s
        if (check != check[where][of]).any():  # two pieces share one half of the hash: look at each
            keys = zip(h.tolist(), check.tolist(), first.tolist(), end.tolist())
            of_piece = []
            for p, q, a, b in keys:
                if (p, q) not in self.slots:
                    self.slots[p, q] = self._add(self.encode(whole[a:b].decode("utf-8", "replace")))
                of_piece.append(self.slots[p, q])
            piece = np.array(of_piece)
        else:
            piece = slot[of]
        count = self.count[piece]
        ends = np.cumsum(count)
        ids = self.store[np.arange(ends[-1]) + np.repeat(self.at[piece] - (ends - count), count)]
        text_of = np.repeat(np.arange(len(texts)), sizes)[first]
        return ids, np.bincount(text_of, count, len(texts)).astype(np.int64)

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of every text."""
        group: list[bytes] = []
        total = 0
        for t in [*texts, None]:
            if group and (t is None or total + len(t) > BYTES):
                if total and self.cuttable:
                    ids, counts = self._few(group)
                    yield from np.split(ids, np.cumsum(counts)[:-1])
                else:
                    yield from (np.array(self.encode(g.decode("utf-8", "replace")), np.uint32) for g in group)
                group, total = [], 0
            if t is not None and len(t) > BYTES:
                yield np.array(self.encode(t.decode("utf-8", "replace")), np.uint32)
            elif t is not None:
                group.append(t)
                total += len(t)


def tokenized(docs: DataFrame, spec: str, id_col: str, text: str, source: str, end: int) -> DataFrame:
    """(row, doc_id, source, n, ids): the number and the ids of the tokens of every text and
    the end id, as little-endian numbers of two bytes if the vocabulary allows, else four. ``row`` numbers the rows of the scan."""
    wide = _width(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        tail = np.array([end], f"<u{wide}").tobytes()
        for batch in batches:
            encoder = encoder or Encoder(spec)
            texts = [t or b"" for t in batch.column(3).to_pylist()]
            ids = [x.astype(f"<u{wide}").tobytes() + tail for x in encoder(texts)]
            counts = pa.array([len(x) // wide for x in ids], pa.int64())
            columns = [*(batch.column(i) for i in range(3)), counts, pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "source", "n", "ids"])

    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].cast("long").alias("doc_id"),
        docs[source].cast("string").alias("source"),
        docs[text].cast("binary").alias("text"),
    )
    return texts.mapInArrow(run, "row long, doc_id long, source string, n long, ids binary")


def _width(spec: str) -> int:
    d = json.loads(spec)
    vocab = d["model"]["vocab"]
    most = max([len(vocab), *(t["id"] + 1 for t in d.get("added_tokens", []))])
    return 2 if most <= 1 << 16 else 4


def _earlier(df: DataFrame, by: list[str], chunk: str, size: Column) -> DataFrame:
    """(by, chunk, before): the sum of ``size`` over the chunks before, in two steps, so that one
    task sees a bounded part of the chunks."""
    step = 4096
    sums = df.groupBy(*by, chunk).agg(F.sum(size).alias("sum")).withColumn("_part", F.floor(F.col(chunk) / step))
    past = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("_in", F.coalesce(F.sum("sum").over(past(*by, "_part").orderBy(chunk)), F.lit(0)))
    parts = sums.groupBy(*by, "_part").agg(F.sum("sum").alias("sum"))
    parts = parts.withColumn("_out", F.coalesce(F.sum("sum").over(past(*by).orderBy("_part")), F.lit(0)))
    on = F.col("i._part") == F.col("o._part")
    for c in by:
        on = on & F.col(f"i.{c}").eqNullSafe(F.col(f"o.{c}"))
    joined = inside.alias("i").join(parts.alias("o"), on)
    return joined.select(*[F.col(f"i.{c}") for c in by], F.col(f"i.{chunk}"), (F.col("_in") + F.col("_out")).alias("before"))


def place(sizes: DataFrame, targets: dict[str, float] | None, length: int, packet: int) -> DataFrame:
    """(row, start, length, sequence_id, offset) for (row, source, n): where each piece goes."""
    sizes = sizes.withColumn("chunk", F.shiftright("row", 33))
    before = stored(_earlier(sizes, ["source"], "chunk", F.col("n")), "before")
    targets = targets or {}
    free = F.col("source").isNull() | ~F.col("source").isin(*targets)
    every, rest = sizes.agg(F.sum("n"), F.sum(F.when(free, F.col("n")))).first()
    # a source without a target gets its part of what the targets leave
    left = max(1e-9, 1.0 - sum(targets.values())) if targets else 1.0
    share = F.col("total") * F.lit(left / (rest or every or 1))
    for name, value in targets.items():
        share = F.when(F.col("source") == name, F.lit(float(value))).otherwise(share)
    queues = sizes.groupBy("source").agg(F.sum("n").alias("total"))
    queues = stored(queues.select("source", (share * length).alias("quantum")), "queues")
    inside = Window.partitionBy("source", "chunk").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.withColumn("in", F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("s")
    b, q = before.alias("b"), queues.alias("q")
    s = s.join(b, F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.chunk") == F.col("b.chunk")))
    s = s.join(q, F.col("s.source").eqNullSafe(F.col("q.source"))).select(
        "s.row", "s.source", "n", (F.col("in") + F.col("before")).alias("base"), "quantum"
    )
    packets = s.select(
        "row", "source", "n", "base", "quantum",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(packet).cast("long"))).alias("start"),
    ).withColumn("len", F.least(F.lit(packet).cast("long"), F.col("n") - F.col("start")))
    packets = packets.withColumn(
        "round", F.ceil((F.col("base") + F.col("start") + F.col("len")) / F.col("quantum")).cast("long")
    ).select("row", "source", "start", "len", "round", F.floor((F.col("round") - 1) / ROUNDS).alias("block"))
    packets = stored(packets, "packets")
    earlier = stored(_earlier(packets, [], "block", F.col("len")), "blocks")
    order = Window.partitionBy("block").orderBy("round", "source", "row", "start")
    order = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = packets.withColumn("in", F.coalesce(F.sum("len").over(order), F.lit(0))).join(earlier, "block")
    at = F.col("in") + F.col("before")
    cut = placed.select(
        "row", "start", "len", at.alias("at"),
        F.explode(F.sequence(F.floor(at / length), F.floor((at + F.col("len") - 1) / length))).alias("sequence_id"),
    )
    begin = F.greatest(F.col("at"), F.col("sequence_id") * length)
    stop = F.least(F.col("at") + F.col("len"), (F.col("sequence_id") + 1) * length)
    return cut.select(
        "row", (F.col("start") + begin - F.col("at")).alias("start"), (stop - begin).alias("length"),
        "sequence_id", (begin - F.col("sequence_id") * length).alias("offset"),
    )


def pack(
    docs: DataFrame,
    spec: str,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    length: int = LENGTH,
    packet: int = PACKET,
    targets: dict[str, float] | None = None,
    end: int = END,
) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): all tokens of all documents,
    cut into the pieces of sequences of ``length``. ``ids`` holds little-endian numbers of 4 bytes.

    ``spec`` is the text of a tokenizer file. ``targets`` gives shares of tokens for some sources;
    without it every source's share is its part of all tokens. Only the last sequence is not full.
    A null or empty text is the end id alone; a null source is a queue of its own; every row is a
    document, so repeated rows are packed each. An empty table gives no pieces.
    """
    wide = _width(spec)
    tokens = stored(tokenized(docs, spec, id_col, text, source, end), "tokens", "zstd")
    pieces = place(tokens.select("row", "source", "n"), targets, length, packet)
    pieces = pieces.groupBy("row").agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces")
    )
    both = tokens.join(pieces, "row").select("doc_id", "ids", "pieces")
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
        + [("ids", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            flat = lists.flatten()
            start, size, sequence, offset = (flat.field(k) for k in range(4))
            counts = np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(batch.num_rows), counts)
            wide_ids = [np.frombuffer(x.as_buffer(), f"<u{wide}") for x in batch.column(1)]
            tokens_of = np.array([len(x) for x in wide_ids], np.int64)
            parts = [
                wide_ids[k][a : a + m].astype("<u4").tobytes()
                for k, a, m in zip(owner.tolist(), start.to_pylist(), size.to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner)), start, size, pa.array(tokens_of[owner]),
                    sequence, offset, pa.array(parts, pa.binary()),
                ],
                schema=schema,
            )

    return both.mapInArrow(
        run,
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences, their pieces put together in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select(
        "sequence_id", "n_tokens", joined.alias("ids")
    )


def tokenizer_file() -> str:
    """The text of the tokenizer file that the registered queries use."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents, with a checksum of their ids."""
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
