import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bitekst.llm import packing
from tests.llm import odd

SPEC = packing.tokenizer_file()
parts = st.sampled_from(
    ["a", "the", "The", "é", "漢", "ü", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "　", "\x1c", "\x85",
     "'s", "'", "'ll", ".", ",", "...", "-", "1", "23", "(", ")", "<|endoftext|>", "😀", "_", "à", "â€¯", "\x00", "don't"]
)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(SPEC)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(parts, max_size=25).map("".join), max_size=6))
def test_encoder_equals_the_tokenizer(tokenizer, encoder, texts):
    got = [x.tolist() for x in encoder([t.encode() for t in texts])]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_encoder_on_documents(spark, tokenizer, encoder, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    texts = [r["text"] for r in rows] + [t for _, t, *_ in odd.TEXTS if t]
    want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    assert [x.tolist() for x in encoder(raw)] == want
    monkeypatch.setattr(packing, "BYTES", 3000)  # many groups, some texts longer than one
    monkeypatch.setattr(packing, "KNOWN", 100)
    assert [x.tolist() for x in packing.Encoder(SPEC)(raw)] == want


def check(pieces, ids, length):
    """Every token once and in order, every sequence without gaps, all but the last full."""
    seen = {}
    for p in pieces:
        seen.setdefault(p["sequence_id"], []).append(p)
    for number, parts in seen.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == length or number == max(seen)
    assert sorted(seen) == list(range(len(seen)))
    docs = {}
    for p in pieces:
        docs.setdefault(p["doc_id"], []).append(p)
    assert set(docs) == set(ids)
    for doc_id, parts in docs.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[doc_id])
            assert p["ids"] == np.array(ids[doc_id][at : at + p["length"]], "<u4").tobytes()
            at += p["length"]
        assert at == len(ids[doc_id])


def test_pieces(spark, tokenizer):
    rows = [(i, f"text number {i} " * (1 + 37 * i % 90), f"s{i % 3}" if i % 7 else None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t, _ in rows}
    pieces = packing.pack(docs, SPEC, length=256, packet=64).collect()
    check(pieces, ids, 256)
    whole = {r["sequence_id"]: r for r in packing.sequences(packing.pack(docs, SPEC, length=256, packet=64)).collect()}
    assert all(r["n_tokens"] * 4 == len(r["ids"]) for r in whole.values())


def test_targets_are_met(spark):
    rows = [(i, "one two three four five six seven eight " * 20, "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = packing.pack(docs, SPEC, length=512, packet=32, targets={"a": 0.75, "b": 0.25}).toPandas()
    pieces["source"] = ["ab"[i % 2] for i in pieces["doc_id"]]
    by = pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").fillna(0)
    # until the queue of a is dry; a deficit is less than a packet
    running = by[by["a"] > 0].iloc[:-2].cumsum()
    total = running.sum(axis=1)
    assert ((running["a"] - 0.75 * total).abs() <= 2 * 32 + 512 * 0.25).all()
    assert (by.iloc[-3]["a"] == 0) and (by.iloc[-3]["b"] == 512)


def test_odd(spark, tokenizer):
    docs = odd.documents(spark)
    rows = packing.pack(docs, SPEC).collect()
    want = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in odd.TEXTS)
    assert sum(r["length"] for r in rows) == sum(want)
    assert sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == want
    assert packing.pack(odd.documents(spark, []), SPEC).count() == 0


def test_rounds_as_deficit_round_robin(spark):
    """The closed form sends packets in the order of the step-by-step algorithm."""
    rng = np.random.default_rng(4)
    queues = {s: rng.integers(1, 900, n).tolist() for s, n in (("a", 60), ("b", 15), ("c", 4))}
    total = sum(map(sum, queues.values()))
    rows, number = [], 0
    for s, sizes in queues.items():
        for n in sizes:
            rows.append((number, s, n))
            number += 1
    placed = packing.place(spark.createDataFrame(rows, "row long, source string, n long"), None, 1000, 100).collect()
    got = sorted(((r["sequence_id"] * 1000 + r["offset"], r["row"], r["start"]) for r in placed))
    packets = {}
    for row, s, n in rows:
        packets.setdefault(s, []).extend((row, i, min(100, n - i)) for i in range(0, n, 100))
    quantum = {s: 1000 * sum(q) / total for s, q in queues.items()}
    deficit = dict.fromkeys(queues, 0.0)
    stream = []
    while any(packets.values()):
        for s in sorted(packets):
            if packets[s]:
                deficit[s] += quantum[s]
                while packets[s] and packets[s][0][2] <= deficit[s] + 1e-6:
                    deficit[s] -= packets[s][0][2]
                    stream.append(packets[s].pop(0))
    at, want = 0, []
    for row, start, size in stream:
        want.append((at, row, start))
        cut = 1000 - at % 1000
        if cut < size:
            want.append((at + cut, row, start + cut))
        at += size
    assert got == want


