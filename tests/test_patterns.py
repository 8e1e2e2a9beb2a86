import random
import time

import pyarrow as pa
import pytest

from bitekst.functions.patterns import Patterns
from bitekst.operators import terminology as t

TEXT_SCHEMA = "pair_id long, source string"


def random_texts(rng, count):
    words = ["a", "B", "ab", "Term", "term", "x_1", "Æ", "ø", "İ", "ß", "1"]
    gaps = [" ", " ", " ", "-", " - ", "(", ")", "<", "/", ". "]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 9))) for _ in range(count)]


def random_glossary(spark, rng, specials):
    words = ["a", "b", "ab", "x_1", "æ", "ø", "ß", "1"] + ["term"] * specials
    gaps = [" ", " ", "-", " - ", "("] + ["<", "/"] * specials
    terms = {}
    for _ in range(40):
        size = rng.randint(1, 3)
        term = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(size)).strip()
        terms[term if rng.random() < 0.3 else term.rstrip("-(</ ") or "a"] = None
    return spark.createDataFrame([(x, x.upper(), i) for i, x in enumerate(terms)], "src_term string, tgt_term string, ord long")


@pytest.mark.parametrize("specials", [0, 1])
def test_one_walk_gives_what_the_join_and_repeated_replacement_give(spark, specials):
    rng = random.Random(specials)
    texts = [*random_texts(rng, 300), None, "", " ", "-", "a a a a", "a-a-a"]
    df = spark.createDataFrame(list(enumerate(texts)), TEXT_SCHEMA)
    g = random_glossary(spark, rng, specials)
    walked, joined = (sorted(map(str, t.extract_terms(df, g, walk_bytes=b).collect())) for b in (1 << 20, 0))
    assert walked == joined and len(walked) > 300
    for nested in (True, False):
        spliced, replaced = (
            {r.pair_id: r.source for r in t.mark_terms(df, g, nested=nested, walk_bytes=b).collect()} for b in (1 << 20, 0)
        )
        assert spliced == replaced
        assert sum("<TERM>" in (x or "") for x in spliced.values()) > 150


def table(terms):
    n = len(terms)
    return pa.table({"term": terms, "ord": list(range(n)), "pattern": [""] * n, "mark": [""] * n})


def test_failure_links_find_terms_within_terms():
    p = Patterns(table(["a b c d", "b c", "c", "c d e", "d e f g"]), "<TERM>", "</TERM>")
    got = [(p.terms[i], behind) for i, behind in p.hits(["a", " ", "b", " ", "c", " ", "d", " ", "e"], 0, 9)]
    assert sorted(got) == [("a b c d", 7), ("b c", 5), ("c", 5), ("c d e", 9)]


def test_time_does_not_grow_with_the_terms():
    rng = random.Random(1)
    word = lambda: "w%d" % rng.randrange(300_000)
    text = " ".join(word() for _ in range(60_000))

    def seconds(terms):
        p = Patterns(table(terms), "<TERM>", "</TERM>")
        p.marked("", True)
        p.build()
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            p.marked(text, True)
            best = min(best, time.perf_counter() - start)
        return best

    few = seconds(sorted({f"{word()} {word()}" for _ in range(1000)}))
    many = seconds(sorted({f"{word()} {word()} {word()}" for _ in range(100_000)}))
    assert many < 4 * few
