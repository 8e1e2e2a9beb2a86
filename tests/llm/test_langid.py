import itertools

import numpy as np

from bitekst.llm import langid
from tests.llm import odd

WORDS = {
    "aa": "kolo makana rolime tavu selopi nekara dumolo".split(),
    "bb": "schriff dengt wurst quatsch zwirn stumpf flocht".split(),
    "cc": "привет слово дерево книга город улица окно".split(),
}


def texts(lang, n, rng):
    return [" ".join(rng.choice(WORDS[lang], 12)) + "." for _ in range(n)]


def model(spark):
    rng = np.random.default_rng(0)
    rows = [(t, lang) for lang in WORDS for t in texts(lang, 40, rng)] + [(None, "aa"), ("kolo", None)]
    return langid.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_spans_of_mixed_text(spark):
    m = model(spark)
    mixed = "kolo makana rolime tavu - schriff dengt wurst quatsch; город улица окно"
    docs = spark.createDataFrame([(1, mixed), (2, "makana rolime tavu selopi")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in langid.identify(docs, m).collect()}
    got = [(mixed[s["start"] : s["end"]], s["lang"]) for s in out[1]["spans"]]
    assert got == [
        ("kolo makana rolime tavu", "aa"), ("schriff dengt wurst quatsch", "bb"), ("город улица окно", "cc"),
    ]
    assert out[2]["lang_pred"] == "aa" and out[2]["score"] == 1.0


def test_scripts_narrow_the_languages(spark):
    m = model(spark)
    reader = langid.Reader()
    scores, *_ = langid.word_scores(reader, m, ["книга kolo 漢字"])
    langs = m["langs"]
    assert [langs[i] for i in np.flatnonzero(scores[0] > -1e8)] == ["cc"]
    assert [langs[i] for i in np.flatnonzero(scores[1] > -1e8)] == ["aa", "bb"]
    assert (scores[2] > -1e8).all()  # a script of no language rules none out


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(7)
    sizes = np.array([5, 0, 1, 7, 3])
    scores = rng.normal(size=(sizes.sum(), 3)) * 4
    got = langid.viterbi(scores, sizes, 2.5)
    at = 0
    for n in sizes:
        part = scores[at : at + n]
        value = lambda ls: sum(part[i, x] for i, x in enumerate(ls)) - 2.5 * sum(
            a != b for a, b in zip(ls, ls[1:])
        )
        best = max(value(ls) for ls in itertools.product(range(3), repeat=int(n)))
        assert abs(value(got[at : at + n].tolist()) - best) < 1e-9
        at += n


def test_words_are_runs_of_letters():
    sample = ["Ab1c d_é\n漢字x", "", "ÀÇ-z 😀q"]
    low, text_of, first, end, _ = langid.Reader().words(sample)
    joined = " " + " ".join(sample) + " "
    assert [joined[a:b] for a, b in zip(first, end)] == ["Ab", "c", "d", "é", "漢字x", "ÀÇ", "z", "q"]
    assert text_of.tolist() == [0, 0, 0, 0, 0, 2, 2, 2]
    assert "".join(map(chr, low[first[5] : end[5]])) == "àç"


def test_batches_of_next_to_nothing(spark):
    m = model(spark)
    for text in ("", "x", " ", "1"):
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)
        assert langid.identify(docs, m).count() == 1


def test_slices_do_not_change_results(spark, monkeypatch):
    m = model(spark)
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame(
        [(i, " ".join(texts(lang, 1, rng)[0] for lang in rng.choice(list(WORDS), 3))) for i in range(30)],
        "doc_id long, text string",
    ).coalesce(1)
    whole = langid.identify(docs, m).collect()
    monkeypatch.setattr(langid, "CHARS", 100)
    monkeypatch.setattr(langid, "WORDS", 60)
    assert langid.identify(docs, m).collect() == whole


def test_odd(spark):
    m = model(spark)
    docs = odd.documents(spark)
    rows = langid.identify(docs, m).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0.0 <= r["score"] <= 1.0
        if r["doc_id"] in (2, 3, 4, 5):
            assert (r["lang_pred"], r["score"], r["spans"]) == ("und", 0.0, [])
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in WORDS
    nothing = langid.learn(odd.documents(spark, []))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(odd.documents(spark, []), m).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in langid.op10(spark, sf).collect() if r["held_out"]]
    assert len(rows) > 200
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) / len(rows) > 0.98


def test_only_letters_make_words():
    """Digits, symbols and marks of any plane are no letters; a mark continues a word only."""
    reader = langid.Reader()
    texts = ["\U0001d7ce\U0001d7cf", "\U0001d11e", "\u0301", "\U000e0001", "\U000e0100", "12 \u0301 ..", "e\u0301t", "\u0301et", "\U00020000"]
    _, text_of, first, end, _ = reader.words(texts)
    assert text_of.tolist() == [6, 7, 8]
    assert (end - first).tolist() == [3, 2, 1]
    assert reader.words([])[1].size == 0
