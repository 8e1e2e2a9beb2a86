"""The pipeline against a plain version of its stages, and odd documents through every stage."""

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as pipeline
from bitekst.llm import decontam, langid, lines, packing
from bitekst.llm.common import stored
from tests.llm import odd
from tests.llm.test_minhash import plain_shingles, similarity
from tests.llm.test_simhash import groups

SF = "/root/testdata/sf0.001"


def plain_lines(docs):
    pages, seen = {}, {}
    for d in docs:
        pages[d["source"]] = pages.get(d["source"], 0) + 1
        for line in {x.strip(" ") for x in d["text"].split("\n")} - {""}:
            seen[d["source"], line] = seen.get((d["source"], line), 0) + 1
    drop = {k for k, n in seen.items() if n >= lines.MIN_PAGES and n > lines.RATIO * pages[k[0]]}
    out = []
    for d in docs:
        kept = [x for x in d["text"].split("\n") if (d["source"], x.strip(" ")) not in drop]
        changed = len(kept) < len(d["text"].split("\n"))
        text = "\n".join(kept) if changed else d["text"]
        if not (changed and not text.strip(" ")):
            out.append(d | {"text": text})
    return out


def plain_near(docs):
    sets = {d["doc_id"]: plain_shingles(d["text"]) for d in docs}
    ids = sorted(sets)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if similarity(sets[a], sets[b]) >= 0.8]
    label = groups(near, ids)
    return [d for d in docs if label[d["doc_id"]] == d["doc_id"]]


def plain_decontam(docs, items):
    def windows(text):
        words = decontam.Words()
        found = decontam._windows([text], words)
        if found is None:
            return {}
        ids, kind, _, _, h, ok = found
        return {
            i: (int(h[i]), [(kind[j], words.cores[ids[j]]) for j in range(i, i + decontam.WINDOW) if kind[j]])
            for i in np.flatnonzero(ok).tolist()
        }

    bench = [windows(t) for t in items]
    out = []
    for d in docs:
        mine = windows(d["text"])
        by_hash = {}
        for i, (h, slots) in mine.items():
            by_hash.setdefault(h, []).append((i, slots))
        leak = False
        for item in bench:
            diagonals = {}
            for i, (h, slots) in item.items():
                for j, other in by_hash.get(h, ()):
                    diagonals.setdefault(j - i, []).append((i, slots, other))
            good = set()
            for found in diagonals.values():
                pairs = {(a, b) for _, x, y in found for a, b in zip(x, y)}
                if len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}):
                    good |= {i for i, _, _ in found}
            leak |= bool(item) and len(good) >= np.ceil(decontam.SHARE * len(item))
        if not leak:
            out.append(d)
    return out


def test_against_plain_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [r.asDict() for r in table.collect()]
    model = langid.learn(table)
    judged = {r["doc_id"]: r for r in langid.identify(table, model, spans=False).collect()}
    docs = [d for d in docs if judged[d["doc_id"]]["lang_pred"] != "und" and judged[d["doc_id"]]["score"] >= pipeline.ONE_LANGUAGE]
    assert len(docs) >= 199
    docs = plain_lines(docs)
    docs = plain_near(docs)
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = plain_decontam(docs, items)
    tokenizer = Tokenizer.from_str(packing.tokenizer_file())
    ids = {d["doc_id"]: [*tokenizer.encode(d["text"], add_special_tokens=False).ids, 1] for d in docs}
    rows = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(ids)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert bytes(r["ids"]) == np.array(part, "<u4").tobytes() and r["doc_tokens"] == len(ids[r["doc_id"]])
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))


def test_odd_documents_through_all_stages(spark):
    for rows in (odd.TEXTS, []):
        docs = stored(odd.documents(spark, rows), "odd")
        for name, stage in pipeline.STAGES:
            out = stored(stage(spark, docs, SF), name)
            if name != "packing":
                assert out.columns == docs.columns
                assert {r["_llm_row"] for r in out.collect()} <= {0}
            docs = out
        if rows:
            assert {r["doc_id"] for r in docs.collect()} >= {1, 6, 7, 8}
        else:
            assert docs.count() == 0


def test_entry_lists_all():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names
