"""Secret scan: fixed patterns, and values in a credential context that are hard to guess.

The cost of guessing a value is the smallest sum over all ways to cut it into dictionary words,
dates, repeats, keyboard walks, sequences and brute-force characters, found by dynamic programming
(log10 of guesses; a cut costs extra, as the guesser has to find it). A value behind a credential
word is reported if its cost reaches a threshold, whatever characters it consists of: placeholders
like ``changeme123`` and ordinary words stay below it.

Words are ranked by the number of documents that hold them (all documents are counted, the values
behind credential words left out, so that a secret does not become a word by being copied), and by
their place in the vocabulary of a public tokenizer if one is given.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitekst.llm.common import by_batch, stored

#: Reported from 10^10 guesses on, and from 10^14 if only a blank stands between the credential word
#: and the value, as in prose.
THRESHOLD, WEAK = 10.0, 14.0
#: The words counted in the corpus that go to the tasks (at most; the most frequent ones), and the
#: lengths of a word.
RANKED, SHORTEST, LONGEST = 50_000, 2, 20
#: Documents that must hold a counted word.
SEEN = 2
CUT = 0.3
#: log10 of guesses: of a mark between words, of a further character of a repeat or sequence, of a
#: further key of a walk, of other spellings of a word (capitals; letters written as marks).
BETWEEN, AGAIN, KEY, SPELLED = 0.5, 0.05, 0.35, 0.5
#: Words that guessers try first, most frequent first.
WORDS = (
    "password passwd pass admin administrator root user guest login welcome letmein qwerty abc secret token "
    "change changeme default test testing example sample demo master dragon monkey shadow sunshine princess "
    "football baseball superman batman iloveyou hello world love god money summer winter spring autumn monday "
    "friday january june july august london paris berlin google apple linux windows oracle mysql server client "
    "access private public key value string null none true false your my here placeholder redacted xxx foo bar"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Letters written as digits or marks.
LEET = str.maketrans("013457@$!", "oleastasi")

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}+")
CONTEXT_WORDS = (
    "password", "passwd", "passphrase", "pass", "pwd", "pin", "secret", "token", "bearer", "credential",
    "authorization", "auth", "login", "private_key", "access_key", "client_secret", "api_key", "apikey", "api key",
)
_WORDS = "|".join(sorted(CONTEXT_WORDS, key=len, reverse=True))
CONTEXT = re.compile(
    rf"(?<![A-Za-z0-9])(?ai:{_WORDS})s?+"
    r"(?:[\"']?[\x20\t]*+(?:([:=]|(?ai:is|was)(?=[\x20\t])))|(?=[\x20\t]))"
    r"[\x20\t]*+(?:((?ai:basic|bearer))[\x20\t]++)?[\"'`]?([^\s\"'`<>,;()\[\]{}]{6,}+)"
)
#: The same for Spark, to leave the values out when words are counted.
CONTEXT_SQL = (
    rf"(?<![A-Za-z0-9])(?i:{_WORDS})s?+"
    r"(?:[\"']?[\x20\t]*+(?:[:=]|(?i:is|was)(?=[\x20\t]))|(?=[\x20\t]))"
    r"[\x20\t]*+(?:(?i:basic|bearer)[\x20\t]++)?[\"'`]?[^\s\"'`<>,;()\[\]{}]{6,}+"
)
WORD_SQL = rf"(?<![\p{{L}}\p{{N}}])[\p{{Lu}}\p{{Lo}}]?[\p{{Ll}}\p{{Lo}}]{{{SHORTEST - 1},{LONGEST - 1}}}+(?![\p{{L}}\p{{N}}])"
_HEX_ONLY = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))


def _adjacent() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for c, key in enumerate(row):
            around = [(r, c - 1), (r, c + 1), (r - 1, c), (r - 1, c + 1), (r + 1, c), (r + 1, c - 1)]
            near[key] = {ROWS[y][x] for y, x in around if 0 <= y < len(ROWS) and 0 <= x < len(ROWS[y])}
    return near


NEAR = _adjacent()
MARKS = frozenset("-_./+ ")
DATE_LENGTHS = (4, 6, 8, 10)
DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|"
    r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d"
)


def _brute(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return math.log10(26) if c.isascii() else 2.0
    return math.log10(33)


def ranking(*lists: Iterable[str]) -> dict[str, float]:
    """log10 of the guesses that a word takes: the best of its places in the lists, most frequent
    first. Words come in lower case, of ``SHORTEST`` to ``LONGEST`` characters."""
    rank: dict[str, int] = {}
    for words in lists:
        for place, word in enumerate(words, 2):
            rank[word] = min(place, rank.get(word, place))
    return {w: math.log10(r) for w, r in rank.items()}


KNOWN = ranking(WORDS)


def vocabulary_words(path: str) -> list[str]:
    """The whole words (letters only, behind a blank) of a byte-level vocabulary file, in its order."""
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = ((i, w[1:].lower()) for w, i in ids.items() if w.startswith("\u0120") and w[1:].isascii() and w[1:].isalpha())
    return list(dict.fromkeys(w for _, w in sorted(words) if SHORTEST <= len(w) <= LONGEST))


def corpus_words(docs: DataFrame, text: str = "text", most: int = RANKED, seen: int = SEEN) -> list[str]:
    """The words that most documents hold, most frequent first (ties by code point): at most
    ``most``, each in ``seen`` documents or more. All whole texts are counted, a document once a
    word; values behind credential words are left out."""
    rest = F.regexp_replace(docs[text], CONTEXT_SQL, " ")
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(WORD_SQL), 0), F.lower))).alias("w"))
    counted = words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= seen)
    # written first: a collected limit would bring as many rows of every partition to the driver
    top = stored(counted.orderBy(F.desc("n"), "w").limit(most), "words").collect()
    return [r["w"] for r in sorted(top, key=lambda r: (-r["n"], r["w"]))]


def guess_cost(value: str, known: dict[str, float] | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of a value takes; 0 for an empty one.

    Segments: a character by brute force; a repeat, a sequence or a keyboard walk of three or more
    characters; a word of ``known``, as it is, with capitals or with letters written as digits or
    marks; a date; a mark between two segments. Time grows in proportion to the length of the value,
    and no segment but a word is limited in length.
    """
    known = KNOWN if known is None else known
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(LEET)
    cost = [0.0] + [math.inf] * n
    walk = run = step = 1  # lengths of the walk, repeat and sequence that end at the character
    in_walk = in_run = in_step = math.inf  # cheapest costs with such a segment at the end
    way = 0
    for i in range(1, n + 1):
        c = low[i - 1]
        if i > 1:
            before, turn = low[i - 2], ord(c) - ord(low[i - 2])
            run = run + 1 if turn == 0 else 1
            walk = walk + 1 if c in NEAR.get(before, ()) else 1
            step = (step + 1 if turn == way else 2) if abs(turn) == 1 else 1
            way = turn
        # a longer segment, or one of three characters that starts anew
        fresh = cost[i - 3] + CUT if i > 2 else math.inf
        in_run = min(in_run + AGAIN, fresh + _brute(c) + 3 * AGAIN) if run > 2 else math.inf
        in_step = min(in_step + AGAIN, fresh + 1.0 + 3 * AGAIN) if step > 2 else math.inf
        in_walk = min(in_walk + KEY, fresh + math.log10(len(NEAR)) + 2 * KEY) if walk > 2 else math.inf
        if step == 2:
            in_step = math.inf
        # upper case inside a word is one more thing to find
        best = min(cost[i - 1] + _single(value, low, i), in_run, in_step, in_walk)
        for k in range(SHORTEST, min(i, LONGEST) + 1):
            word = _word(value, low, plain, i - k, i, known)
            if word is not None:
                best = min(best, cost[i - k] + CUT + word)
        for k in DATE_LENGTHS:
            if k <= i and c.isdigit() and DATE.fullmatch(value, i - k, i):
                best = min(best, cost[i - k] + CUT + _date(k))
        cost[i] = best
    return cost[n]


def _single(value: str, low: str, i: int) -> float:
    if value[i - 1] in MARKS and 1 < i < len(value):
        return BETWEEN
    return _brute(low[i - 1]) + (math.log10(2) if value[i - 1] != low[i - 1] else 0.0)


def _word(value: str, low: str, plain: str, a: int, b: int, known: dict[str, float]) -> float | None:
    guesses, extra = known.get(low[a:b]), 0.0
    if guesses is None:
        guesses, extra = known.get(plain[a:b]), SPELLED
    if guesses is None:
        return None
    return guesses + extra + (SPELLED if value[a:b] != low[a:b] else 0.0)


def _date(k: int) -> float:
    return math.log10(120) if k == 4 else math.log10(365 * 120)


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed, of the fixed patterns."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    out = []
    low = raw.lower()
    if any(k in low for k in (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in raw.translate(_HEX_ONLY):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, BASE_KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def guess_spans(
    text: str,
    base: list[tuple[int, int, str]],
    threshold: float,
    raw: bytes,
    known: dict[str, float] | None = None,
    weak: float = WEAK,
) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, cost) of values in a credential context that cost at least ``threshold``
    (``weak`` if no mark, ``is`` or ``was`` joins them to the credential word) and overlap no base span."""
    low = raw.lower()
    if not any(w.encode() in low for w in CONTEXT_WORDS):
        return []
    out, covered = [], sorted((s, e) for s, e, _ in base)
    at = last = 0  # base spans that start before a value ends, and where the last of them ends
    for m in CONTEXT.finditer(text):
        start, end = m.span(3)
        end -= len(m[3]) - len(m[3].rstrip(".!?:"))
        while at < len(covered) and covered[at][0] < end:
            last = max(last, covered[at][1])
            at += 1
        if end - start < 6 or last > start:
            continue
        cost = guess_cost(text[start:end], known)
        if cost >= (threshold if m[1] or m[2] else weak):
            out.append((start, end, "guess", cost))
    return out


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    weak: float = WEAK,
    vocabulary: str | None = None,
) -> DataFrame:
    """(doc_id, found), one row per row: start, end (code points, end exclusive) and kind of every
    secret, by start, then kind (assign, access, hex, guess), and the guess cost of the last kind.

    Words are ranked over all texts of ``docs`` (``corpus_words``), and by a vocabulary file that the
    driver reads, if one is named. Null and empty texts have no secrets, an empty table gives no
    rows. Values of any length are scanned whole, in time proportional to it. Repeated rows get equal
    results; further columns of ``docs`` are not looked at. Where a value could be cut in several ways
    of equal cost, the cost is the same, so ties change nothing.
    """
    known = ranking(WORDS, corpus_words(docs, text), vocabulary_words(vocabulary) if vocabulary else ())

    def make():
        def one(text):
            if not text:
                return []
            raw = text.encode("utf-8", "surrogatepass")
            base = base_spans(text, raw)
            spans = [(*x, None) for x in base] + guess_spans(text, base, threshold, raw, known, weak)
            order = {k: i for i, k in enumerate((*BASE_KINDS, "guess"))}
            spans.sort(key=lambda x: (x[0], order[x[2]], x[1]))
            return [{"start": s, "end": e, "kind": k, "log10_guesses": c} for s, e, k, c in spans]

        return lambda b: {"doc_id": b["doc_id"], "found": [one(t) for t in b["text"]]}

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].alias("text"))
    schema = "doc_id long, found array<struct<start: long, end: long, kind: string, log10_guesses: double>>"
    return by_batch(texts, make, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the secrets of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_secrets(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
    mark = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda xs: F.array_join(F.transform(xs, mark), ",")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        count("guess").alias("n_guess"),
    )
