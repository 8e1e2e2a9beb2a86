import random

from bitekst.functions.fuzzy import partial_ratio, reaches


def test_threshold_needs_no_other_windows():
    """The check that rules windows out by shared characters says what the best ratio says."""
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abcå ") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("abcdå ") for _ in range(rng.randint(0, 40)))
        threshold = rng.choice([0.5, 0.6, 0.75, 0.8, 0.9, 1.0])
        found, windows, left = reaches(a, b, threshold)
        assert found == (partial_ratio(a, b) >= threshold), (a, b, threshold)
        assert left <= windows


def test_few_windows_are_left():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(20_000))
    found, windows, left = reaches("ponderable", text, 0.8)
    assert not found and windows == 20_009 and left < 0.01 * windows


def test_long_terms():
    text = "x" * 50 + "the long term of more than sixty-four characters, which needs three words of bits" + "y" * 50
    term = "the long term of more than sixty four characters, which need three words of bits!"
    assert reaches(term, text, 0.9)[0] and not reaches(term, text[::-1], 0.9)[0]
