"""Terms of many texts rated together, and fuzzy accuracy in the row."""

import random
from collections import Counter

from bitekst.functions import fuzzy
from bitekst.operators import terminology as t


def test_many_texts_as_one_by_one(monkeypatch):
    rng = random.Random(8)
    jobs = []
    for _ in range(150):
        text = "".join(rng.choice("abcdå \U0001f600") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 200, 700])))
        terms = ["".join(rng.choice("abcdeå ") for _ in range(n)) for n in rng.choices([0, 1, 2, 3, 5, 6, 7, 12, 40, 64, 65], k=4)]
        terms += [text[a : a + n] for a, n in [(3, 9), (0, 6), (60, 8)] if text[a : a + n]]
        terms += [x[:2] + rng.choice("abx") + x[3:] for x in terms if len(x) > 4]
        jobs.append((terms, text))
    for threshold in (0.5, 0.8, 1.0):
        want = [[fuzzy.reaches(x, text, threshold) for x in terms] for terms, text in jobs]
        for held, asked, texts in ((1 << 18, 1 << 16, 256), (64, 8, 256), (1 << 18, 1 << 16, 3)):
            for name, value in (("HELD", held), ("ASKED", asked), ("TEXTS", texts)):
                monkeypatch.setattr(fuzzy, name, value, raising=False)
            assert fuzzy.rate_texts(jobs, threshold, {}) == want


def test_texts_are_searched_together(monkeypatch):
    """Before, every text was searched alone for each of its characters."""
    calls = Counter()
    rate = fuzzy._rate_group
    monkeypatch.setattr(fuzzy, "_rate_group", lambda *a: calls.update(["group"]) or rate(*a))
    fuzzy.rate_texts([(["oil rig", "gas rig"], "the rigs of oil and of gas " * 20)] * 200, 0.8, {})
    assert calls["group"] == 1


GLOSSARY = [("sea", "hav", 1), ("blue sea", "blått hav", 2), ("ocean", "hav", 3), ("sky", "himmelen", 4)]
ROWS = [
    (1, "The Blue Sea, the ocean.", "Et blått hav"), (2, "sky and sea", "himmele og sjø"), (3, "none", "hav"),
    (5, None, None), (6, "sea", None), (None, "sky", "himmelen"), (7, "sky", "HIMMELENE"),
]
AGAIN = [(4, "sky", "sol"), (4, "rain", "Himmelen"), (8, "sea sky", "havet"), (8, "sea", "hav hav"), (8, "", "himmel")]


def tables(spark, rows):
    glossary = spark.createDataFrame(GLOSSARY, "src_term string, tgt_term string, ord long")
    return spark.createDataFrame(rows, "pair_id long, source string, prediction string"), glossary


def plain(rows):
    """(pair_id, term, found, windows, compared) as the question reads: a term that a row of the id has as
    a whole word counts in those rows, any other is looked for in every row of the id."""
    lower = [(i, (s or "").lower(), (p or "").lower()) for i, s, p in rows]
    words = lambda x: set(x.replace(",", " ").replace(".", " ").split())
    has = lambda x, term: set(term.split()) <= words(x) and term in x
    out = []
    for i in {i for i, _, _ in lower} - {None}:
        mine = [(s, p) for j, s, p in lower if j == i]
        for term in {g[1] for g in GLOSSARY for s, _ in mine if has(s, g[0])}:
            whole = [p for _, p in mine if has(p, term)]
            out += [(i, term, True, None, None) for _ in whole]
            if not whole:
                out += [(i, term, *fuzzy.reaches(term, p, 0.8)) for _, p in mine]
    return out


def test_row_by_row_and_ids_that_repeat(spark):
    for rows in (ROWS, ROWS + AGAIN, []):
        df, glossary = tables(spark, rows)
        want = plain(rows)
        counts = {i: (sum(w[0] == i for w in want), sum(w[0] == i and w[2] for w in want)) for i, _, _ in rows}
        for most in (t.WALK_BYTES, 0):
            got = t.term_accuracy_rows(df, glossary, walk_bytes=most).select("pair_id", "term_count", "correct_terms")
            assert Counter(map(tuple, got.collect())) == Counter((i, *counts[i]) for i, _, _ in rows)
            expected = t.expected_terms(df, glossary, walk_bytes=most)
            found = t.term_in_prediction(df, expected, glossary, walk_bytes=most)
            assert Counter(map(tuple, found.collect())) == Counter(w[:3] for w in want)
            line = t.fuzzy_windows(df, expected, glossary, walk_bytes=most).first()
            rated = [w for w in want if w[3] is not None]
            assert tuple(line) == (len(rated), *(sum(w[k] for w in rated) for k in (2, 3, 4)))


def test_nothing_moves_and_nothing_is_walked_twice(spark):
    df, glossary = tables(spark, ROWS)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    rows = plan(t.term_accuracy(t.term_accuracy_rows(df, glossary)))
    assert rows.count("ArrowEvalPython") == 1 and "Join" not in rows and rows.count("Exchange") == 1
    found = plan(t.term_in_prediction(df, t.expected_terms(df, glossary), glossary))
    assert found.count("ArrowEvalPython") == 2 and found.count("Join [") == 1
