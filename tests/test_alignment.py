import numpy as np
import pytest
from pyspark.sql import functions as F

from bitekst.operators import alignment as al

SCHEMA = "doc_id long, side string, pos long, sent string, v array<double>"


def make(spark, docs):
    """docs: {doc_id: (en vectors, no vectors)}"""
    rows = []
    for doc, sides in docs.items():
        for side, vectors in zip(("en", "no"), sides):
            for pos, v in enumerate(vectors):
                rows.append((doc, side, pos, f"{side}{pos}", [float(x) for x in v]))
    return spark.createDataFrame(rows, SCHEMA)


def cosines(a, b):
    a, b = (np.array(x, dtype=float) for x in (a, b))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    return a @ b.T


def greedy(a, b, threshold):
    sims = cosines(a, b)
    cells = sorted(
        (-sims[i, j], i, j) for i in range(len(a)) for j in range(len(b)) if sims[i, j] >= threshold
    )
    used_a, used_b, out = set(), set(), set()
    for _, i, j in cells:
        if i not in used_a and j not in used_b:
            used_a.add(i), used_b.add(j), out.add((i, j))
    return out


def found(df):
    return {(r.en_pos, r.no_pos) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 3, 256])
def test_best_partner_does_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(11, 5)), rng.normal(size=(7, 5))
    sims = cosines(a, b)
    rows = al.best_partners(make(spark, {1: (a, b)}), block).collect()
    assert len(rows) == 18
    for r in rows:
        line = sims[r.pos] if r.side == "en" else sims[:, r.pos]
        assert r.other == line.argmax()
        assert r.similarity == pytest.approx(line.max())
        assert r.total == pytest.approx(line.sum()) and r.cells == len(line)


def test_matching_is_greedy_by_similarity(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 4))
    a = np.vstack([base + rng.normal(scale=0.3, size=base.shape) for _ in range(4)])
    b = np.vstack([base + rng.normal(scale=0.3, size=base.shape) for _ in range(3)])
    got = found(al.align_one_to_one(make(spark, {1: (a, b)}), 0.5))
    assert got == greedy(a, b, 0.5)


def test_one_round_is_a_part(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(9, 3)), rng.normal(size=(6, 3))
    docs = make(spark, {1: (a, b)})
    assert found(al.align_one_to_one(docs, 0.2, rounds=1)) <= found(al.align_one_to_one(docs, 0.2))


def test_copies_are_matched_in_order_in_one_round(spark):
    a, b = [[1, 0]] * 40, [[1, 0]] * 30
    docs = make(spark, {1: (a, b)})
    assert found(al.mutual_pairs(docs)) == {(i, i) for i in range(30)}


def test_dispatch(spark):
    eye = np.eye(6)
    docs = make(
        spark,
        {
            1: (eye[:4], eye[:4]),
            2: (eye[:4], eye[1:4]),  # one sentence missing: by position, all wrong
            3: (eye[:5], eye[2:5]),  # two missing: matched
            4: (eye[:2], []),
        },
    )
    aligned = al.align_documents(docs)
    by_doc = {}
    for r in aligned.collect():
        by_doc.setdefault(r.doc_id, set()).add((r.en_pos, r.no_pos, r.method))
        assert r.similarity == pytest.approx(1.0)
        assert (r.en, r.no) == (f"en{r.en_pos}", f"no{r.no_pos}")
    assert by_doc == {
        1: {(i, i, "sequential") for i in range(4)},
        3: {(i + 2, i, "mutual") for i in range(3)},
    }
    stats = {r.doc_id: tuple(r)[1:] for r in al.align_doc_stats(docs, aligned).collect()}
    assert stats == {1: (4, 4, 4, 1.0), 2: (4, 3, 0, 0.0), 3: (5, 3, 3, 1.0), 4: (2, 0, 0, 0.0)}
    row = al.align_summary(al.align_doc_stats(docs, aligned)).first()
    assert (row.total_mt_pairs, row.total_en_sentences, row.total_sentence_pairs) == (4, 15, 7)
    assert row.alignment_rate == pytest.approx(7 / 15 * 100)
    assert row.avg_similarity == pytest.approx(1.0)


def test_empty_input(spark):
    docs = make(spark, {1: ([[1, 0]], [[1, 0]])}).filter("false")
    aligned = al.align_documents(docs)
    assert aligned.count() == 0
    assert al.align_summary(al.align_doc_stats(docs, aligned)).first().alignment_rate is None


def test_threshold_is_inclusive(spark):
    docs = make(spark, {1: ([[1, 0]], [[3, 4]])})
    assert al.align_documents(docs, 0.6 - 1e-12).count() == 1
    assert al.align_documents(docs, 0.61).count() == 0


def test_training_pairs(spark):
    docs = make(spark, {1: ([[1, 0]], [[1, 0]])})
    row = al.clean_training_pairs(al.align_documents(docs)).first()
    assert (row.source, row.target, row.source_lang, row.target_lang) == ("en0", "no0", "en", "no")


def test_progressive_runs_add_up(spark, tmp_path):
    from bitekst.streaming.progress import align_progressively, read_progress

    rng = np.random.default_rng(4)
    docs = {i: (v := rng.normal(size=(4 + i % 3, 6)), v[: 4 + i % 2]) for i in range(6)}
    everything = make(spark, docs)
    paths = [str(tmp_path / n) for n in ("in", "out", "state")]
    everything.filter("doc_id < 3").repartition(2, "doc_id").write.parquet(paths[0])
    align_progressively(spark, *paths, files_per_batch=1)
    first = read_progress(spark, paths[1]).count()
    everything.filter("doc_id >= 3").coalesce(1).write.mode("append").parquet(paths[0])
    align_progressively(spark, *paths, files_per_batch=1)
    saved = read_progress(spark, paths[1]).select("doc_id", "en_pos", "no_pos")
    want = al.align_documents(everything).select("doc_id", "en_pos", "no_pos")
    assert first < want.count()
    assert sorted(saved.collect()) == sorted(want.collect())
    assert read_progress(spark, paths[1], "stats").count() == 6


def test_long_document_spreads_over_block_pairs(spark):
    """Every pair of blocks is a key, and a smaller block gives the same partners."""
    rng = np.random.default_rng(4)
    rows = [(1, s, i, "", rng.normal(size=4).tolist()) for s, n in (("en", 23), ("no", 17)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, side string, pos long, sent string, v array<double>")
    whole = sorted(map(str, al.best_partners(df).drop("total").collect()))
    assert sorted(map(str, al.best_partners(df, block=5).drop("total").collect())) == whole
    text = al.best_partners(df, block=5)._jdf.queryExecution().executedPlan().toString()
    assert "en_block" in text and "no_block" in text


def test_vectors_move_once_per_round(spark, tmp_path):
    rows = [(1, s, i, "", [float(i), 1.0]) for s in ("en", "no") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, side string, pos long, sent string, v array<double>")
    numbered = al.materialize(al.with_copies(df))
    text = al.best_partners(numbered)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "Window" not in text


def test_document_over_two_batches_is_refused(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from bitekst.streaming import progress

    rows = [(d, s, i, f"{s} {i}", [float(i + 1), 1.0]) for d in (1, 2) for s in ("en", "no") for i in range(4)]
    schema = "doc_id long, side string, pos long, sent string, v array<double>"
    paths = [str(tmp_path / n) for n in ("in", "out", "state")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(paths[0])
    progress.align_progressively(spark, *paths)
    before = progress.read_progress(spark, paths[1]).count()
    spark.createDataFrame(rows[:2], schema).coalesce(1).write.mode("append").parquet(paths[0])
    with pytest.raises(StreamingQueryException, match="spread over several batches: 1"):
        progress.align_progressively(spark, *paths)
    assert progress.read_progress(spark, paths[1]).count() == before


PARTS = "doc_id long, side string, pos long, sent string, v array<double>, total int, last boolean"


def part_files(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, PARTS).coalesce(1).write.mode("append").parquet(path)


def three_parts():
    """Documents 1 to 4 and one without an id in three parts; 5 never gets its last sentences."""
    rng = np.random.default_rng(8)
    parts = [[], [], []]
    for doc in (1, 2, 3, 4, 5, None):
        size = 4 + (doc or 0)
        for pos in range(size):
            v = rng.normal(size=5).tolist()
            for side in ("en", "no"):
                if side == "no" and doc in (2, 4) and pos > 2:
                    continue
                total = size + (3 if doc in (2, 4) else size)
                at = 0 if doc == 3 else (pos + (side == "no")) % 3 if doc != 5 else 0
                parts[at].append((doc, side, pos, f"{side} {pos}", v, total + (doc == 5), False))
    return parts


def saved(spark, out, name="pairs"):
    from bitekst.streaming import progress

    return sorted(map(str, progress.read_progress(spark, out, name).drop("batch_id").collect()))


def test_documents_in_parts(spark, tmp_path, monkeypatch):
    from pyspark.errors import StreamingQueryException

    from bitekst.streaming import progress

    parts = three_parts()
    everything = spark.createDataFrame([r for p in parts for r in p], PARTS).drop("total", "last")
    pairs = al.align_documents(everything)
    stats = al.align_doc_stats(everything, pairs)
    complete = "doc_id is null or doc_id != 5"
    want = sorted(map(str, pairs.filter(complete).collect())), sorted(map(str, stats.filter(complete).collect()))
    paths = [str(tmp_path / n) for n in ("in", "out", "state")]
    part_files(spark, paths[0], parts)

    real, calls = progress._align, []

    def fails_once(*args):
        calls.append(args[2])
        if len(calls) == 2:  # parts and open documents of the second batch are written, its pairs are not
            raise RuntimeError("lost")
        real(*args)

    monkeypatch.setattr(progress, "_align", fails_once)
    with pytest.raises(StreamingQueryException, match="lost"):
        progress.align_progressively(spark, *paths, files_per_batch=1, end="total")
    progress.align_progressively(spark, *paths, files_per_batch=1, end="total")
    assert calls == [0, 1, 1, 2]
    assert (saved(spark, paths[1]), saved(spark, paths[1], "stats")) == want
    assert [r["doc_id"] for r in progress.open_documents(spark, paths[1]).collect()] == [5]

    for _ in range(2):  # the second call repeats the first
        progress.finish_open(spark, paths[1])
        assert saved(spark, paths[1]) == sorted(map(str, pairs.collect()))
        assert saved(spark, paths[1], "stats") == sorted(map(str, stats.collect()))
    assert progress.open_documents(spark, paths[1]).count() == 0
    part_files(spark, paths[0], [[(5, "en", 99, "late", [1.0] * 5, 1, True)]])
    with pytest.raises(StreamingQueryException, match="spread over several batches: 5"):
        progress.align_progressively(spark, *paths, files_per_batch=1, end="total")


def test_end_marks_and_idle_documents(spark, tmp_path):
    from bitekst.streaming import progress

    row = lambda doc, side, pos, last=None: (doc, side, pos, "", [float(pos + 1), 1.0], None, last)
    batches = [
        [row(1, "en", 0), row(1, "no", 0), row(2, "en", 0), row(2, "no", 0)],
        [row(1, "en", 1), row(3, "en", 0), row(3, "no", 0)],
        [row(1, "no", 1, True), row(3, "en", 1)],
    ]
    paths = [str(tmp_path / n) for n in ("in", "out", "state")]
    for batch in batches:
        part_files(spark, paths[0], [batch])
        progress.align_progressively(spark, *paths, files_per_batch=1, end="last", idle_batches=2)
    got = progress.read_progress(spark, paths[1], "stats").select("doc_id", "batch_id", "en_sentences", "no_sentences", "aligned_pairs")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 2, 2, 2), (2, 2, 1, 1, 1)]
    assert [tuple(r) for r in progress.open_documents(spark, paths[1]).collect()] == [(3, 1, 2, 3, None, False)]
    with pytest.raises(ValueError, match="idle_batches"):
        progress.align_progressively(spark, *paths, idle_batches=1)
