import random
from collections import Counter

from bitekst.functions import fuzzy


def test_terms_rated_together_as_alone():
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice("abcdå \U0001f600") for _ in range(rng.choice([0, 1, 5, 40, 600])))
        sizes = rng.choices([0, 1, 2, 3, 7, 12, 40, 63, 64, 65, 90], k=rng.randint(0, 8))
        terms = ["".join(rng.choice("abcdeå ") for _ in range(n)) for n in sizes]
        terms += [text[a : a + n] for a, n in [(3, 9), (0, 64), (1, 70)] if text]
        threshold = rng.choice([0.0, 0.5, 0.8, 0.8, 1.0])
        want = [fuzzy.reaches(t, text, threshold) for t in terms]
        assert fuzzy._rate(terms, text, threshold, {}) == want, (terms, text, threshold)


def test_many_equal_characters():
    """Counts beyond a byte, and more windows than are compared at once."""
    for term in ("a" * 64, "ab" * 30):
        text = "a" * 9000 + "ab" * 500
        assert fuzzy._rate([term], text, 0.8, {}) == [fuzzy.reaches(term, text, 0.8)]


def test_a_text_is_searched_once_per_character_not_per_term(monkeypatch):
    """Before, every term searched the whole text for each of its characters."""
    alone = Counter()
    monkeypatch.setattr(fuzzy, "_shared", lambda *_: alone.update(["searched"]))
    fuzzy._rate(["oil rig", "gas rig", "gas oil"] * 10, "the rigs of oil and of gas " * 20, 0.8, {})
    assert not alone
