import random
import re

import pytest
from pyspark.sql import functions as F

from bitekst.functions.fuzzy import partial_ratio
from bitekst.operators import terminology as t

ENTRIES = [
    ("oil well", "oljebrønn"),
    ("oil", "olje"),
    ("Oil Well", " Brønn "),
    ("", "tom"),
    ("beer", "øl"),
    ("term", "uttrykk"),
    ("c++", "c++"),
    ("-based", "basert"),
    ("drill", "bor"),
    ("bore", "bor"),
    ("well", "brønn"),
]
TEXTS = [
    (1, "Oil well and OIL, oilwell; an oil-well."),
    (2, "The term oil. No hit in kjøl or boil."),
    (3, "c++ is c++a, water-based beer"),
    (4, ""),
    (5, "oil oil  oil well well"),
    (6, "drill, bore (drill) 2well _oil"),
    (7, "nothing here"),
]


def glossary(spark):
    rows = [(i, e, n) for i, (e, n) in enumerate(ENTRIES)]
    return t.glossary_load(spark.createDataFrame(rows, "ord long, en string, no string"))


def plain_glossary():
    out = {}
    for en, no in ENTRIES:
        if en.strip() and no.strip():
            out[en.strip().lower()] = no.strip().lower()
    return out


def texts(spark):
    return spark.createDataFrame(TEXTS, "pair_id long, source string")


def test_last_duplicate_wins_first_place_stays(spark):
    rows = {r.src_term: (r.tgt_term, r.ord) for r in glossary(spark).collect()}
    assert rows["oil well"] == ("brønn", 0)
    assert {k: v[0] for k, v in rows.items()} == plain_glossary()
    inverse = {r.src_term: r.tgt_term for r in t.glossary_inverse(glossary(spark)).collect()}
    plain = plain_glossary()
    assert inverse == {v: k for k, v in plain.items()}


def test_terms_found_as_whole_words(spark):
    got = {(r.pair_id, r.term) for r in t.extract_terms(texts(spark), glossary(spark)).collect()}
    want = {
        (i, term)
        for i, text in TEXTS
        for term in plain_glossary()
        if re.search(r"\b" + re.escape(term) + r"\b", text.lower(), re.IGNORECASE)
    }
    assert got == want
    assert (3, "c++") in got and (3, "-based") in got


def test_terms_on_random_texts(spark):
    rng = random.Random(5)
    parts = ["oil", "well", "oil well", " ", " ", "-", "c++", "a", "-based", "øl", "ÆØ", "_", "9"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(12))) for i in range(200)]
    df = spark.createDataFrame(rows, "pair_id long, source string")
    got = {(r.pair_id, r.term) for r in t.extract_terms(df, glossary(spark)).collect()}
    want = {
        (i, term)
        for i, text in rows
        for term in plain_glossary()
        if re.search(r"\b" + re.escape(term) + r"\b", text.lower())
    }
    assert got == want


def plain_mark(text):
    for term in sorted(plain_glossary(), key=len, reverse=True):
        text = re.sub(
            r"\b" + re.escape(term) + r"\b", f"<TERM>{term}</TERM>", text, flags=re.IGNORECASE
        )
    return text


def test_marks_are_nested_like_repeated_replacement(spark):
    got = {r.pair_id: r.source for r in t.mark_terms(texts(spark), glossary(spark)).collect()}
    assert got == {i: plain_mark(text) for i, text in TEXTS}


def test_flat_marks(spark):
    rows = {r.pair_id: r.source for r in t.mark_terms(texts(spark), glossary(spark), nested=False).collect()}
    assert rows[5] == "<TERM>oil</TERM> <TERM>oil</TERM>  <TERM>oil well</TERM> <TERM>well</TERM>"


def test_mark_pairs_notes_metadata(spark):
    df = spark.createDataFrame(
        [(1, "an oil", "en olje", {"a": "b"}), (2, "x", "y", None)],
        "pair_id long, source string, target string, metadata map<string,string>",
    )
    rows = {r.pair_id: r for r in t.mark_pairs(df, glossary(spark)).collect()}
    assert rows[1].source == "an <TERM>oil</TERM>" and rows[1].target == "en <TERM>olje</TERM>"
    assert rows[1].metadata == {"a": "b", "terminology_marked": "true"}
    assert rows[2].metadata == {"terminology_marked": "true"}


def test_coverage(spark):
    row = t.term_stats(texts(spark), glossary(spark)).first()
    hits = t.extract_terms(texts(spark), glossary(spark)).count()
    assert (row.total_samples, row.total_term_occurrences) == (7, hits)
    assert row.avg_terms_per_sample == pytest.approx(hits / 7)
    none = t.term_stats(texts(spark).filter("false"), glossary(spark)).first()
    assert (none.total_samples, none.avg_terms_per_sample) == (0, 0.0)


def slow_ratio(a, b):
    """Longest common subsequence against every window, also cut-off ones."""
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            diagonal = 0
            for j, d in enumerate(y):
                diagonal, row[j + 1] = row[j + 1], max(row[j + 1], row[j], diagonal + (c == d))
        return row[-1]

    short, long = sorted((a, b), key=len)
    orders = [(short, long)] + ([(long, short)] if len(short) == len(long) else [])
    best = 0.0
    for s, x in orders:
        m = len(s)
        windows = [x[max(i, 0) : i + m] for i in range(1 - m, len(x))]
        best = max([best] + [2 * lcs(s, w) / (m + len(w)) for w in windows if w])
    return best


def test_partial_ratio_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        a = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 8)))
        b = "".join(rng.choice("abcde ") for _ in range(rng.randint(1, 20)))
        assert partial_ratio(a, b) == pytest.approx(slow_ratio(a, b)), (a, b)
    for size in (31, 32, 33, 63, 64, 65, 129, 500):  # around the borders of state words
        a = "".join(rng.choice("abc") for _ in range(size))
        b = "".join(rng.choice("abc") for _ in range(size + 40))
        assert partial_ratio(a, b) == pytest.approx(slow_ratio(a, b)), size
    long = "".join(rng.choice("ab") for _ in range(70))
    other = "".join(rng.choice("ab") for _ in range(90))
    assert partial_ratio(long, other) == pytest.approx(slow_ratio(long, other))
    assert partial_ratio("", "x") == 0.0
    assert partial_ratio("øl", "et øl til") == 1.0


def test_accuracy(spark):
    rows = [
        (1, "oil and beer", "olje og øl"),
        (2, "oil and drill", "oljen og noe"),  # olje: similar passage; bor: missing
        (3, "nothing", "ingenting"),
    ]
    df = spark.createDataFrame(rows, "pair_id long, source string, prediction string")
    exact = {r.pair_id: r for r in t.term_accuracy_rows(df, glossary(spark), fuzzy=False).collect()}
    assert (exact[1].term_count, exact[1].correct_terms, exact[1].term_f1) == (2, 2, 1.0)
    assert (exact[2].term_count, exact[2].correct_terms, exact[2].term_f1) == (2, 0, 0.0)
    assert (exact[3].term_count, exact[3].term_recall) == (0, 1.0)
    fuzzy = t.term_accuracy_rows(df, glossary(spark))
    by_id = {r.pair_id: r for r in fuzzy.collect()}
    assert by_id[2].correct_terms == 1 and by_id[2].term_recall == 0.5
    total = t.term_accuracy(fuzzy).first()
    assert total.term_accuracy == pytest.approx(3 / 4)
    assert total.term_recall == pytest.approx(0.75)
    assert total.sentences_with_terms == 2
    assert t.term_accuracy(fuzzy.filter("false")).first().term_accuracy == 0.0


def test_large_glossary_is_joined_without_broadcast(spark):
    from bitekst.session import broadcast_if_small

    g = glossary(spark).select("src_term")
    hinted = broadcast_if_small(g)._jdf.queryExecution().logical().toString()
    plain = broadcast_if_small(g, max_bytes=1)._jdf.queryExecution().logical().toString()
    assert "Hint broadcast" in hinted and "Hint broadcast" not in plain


def test_ten_thousand_terms(spark):
    entries = [(i, f"alpha{i} beta gamma{i % 7} delta epsilon{i}", f"x{i}") for i in range(5000)]
    entries += [(5000 + i, f"alpha{i}", f"y{i}") for i in range(5000)]
    g = t.glossary_load(spark.createDataFrame(entries, "ord long, en string, no string"))
    rows = [
        (1, "see alpha17 beta gamma3 delta epsilon17 and alpha18 beta gamma3 delta epsilon17"),
        (2, " ".join(f"alpha{i} beta" for i in range(2000))),
        (3, "xalpha17 beta"),
    ]
    df = spark.createDataFrame(rows, "pair_id long, source string")
    got = {}
    for r in t.extract_terms(df, g).collect():
        got.setdefault(r.pair_id, set()).add(r.term)
    assert got == {
        1: {"alpha17", "alpha18", "alpha17 beta gamma3 delta epsilon17"},
        2: {f"alpha{i}" for i in range(2000)},
    }
    marked = {r.pair_id: r.source for r in t.mark_terms(df.filter("pair_id <> 2"), g).collect()}
    assert marked[1].count("<TERM>") == 3 and marked[3] == rows[2][1]


def test_very_long_term(spark):
    long = " ".join(f"w{i}" for i in range(60))
    g = t.glossary_load(spark.createDataFrame([(1, long, "x"), (2, "w0 w1", "y")], "ord long, en string, no string"))
    rows = [(1, f"a {long} b"), (2, f"a {long}x"), (3, "w0 w1 w2"), (4, "w0  w1")]
    df = spark.createDataFrame(rows, "pair_id long, source string")
    got = {(r.pair_id, len(r.term)) for r in t.extract_terms(df, g).collect()}
    assert got == {(1, len(long)), (1, 5), (2, 5), (3, 5)}


def test_terms_with_the_mark_in_them(spark):
    entries = [(1, "oil", "x"), (2, "term>oil", "y"), (3, "well<", "z"), (4, "term", "u")]
    g = t.glossary_load(spark.createDataFrame(entries, "ord long, en string, no string"))
    texts_ = ["oil well", "nothing", "a term", "well oil"]
    df = spark.createDataFrame(list(enumerate(texts_)), "pair_id long, source string")

    def plain(text):
        for term in sorted((e[1] for e in entries), key=len, reverse=True):
            text = re.sub(r"\b" + re.escape(term) + r"\b", f"<TERM>{term}</TERM>", text, flags=re.IGNORECASE)
        return text

    got = {r.pair_id: r.source for r in t.mark_terms(df, g).collect()}
    assert got == {i: plain(x) for i, x in enumerate(texts_)}
