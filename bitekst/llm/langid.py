"""Language identification with labelled spans of mixed-language text.

The script of a word (by the Unicode range of its first letter) narrows the languages down to those
that were seen in it. Every word gets a score for each of these from the character n-grams of the
training texts; Viterbi with a penalty for switching then labels all the words of a text, and
neighbours of one label form a span. The language of the text is the one with the most letters.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitekst.llm.common import ROW, by_batch, numbered

UNKNOWN = "und"
#: Longest n-gram (with word borders), and log2 of the number of feature places.
ORDER, FEATURE_BITS = 4, 16
#: What a change of language costs, in nats.
SWITCH = 6.0
#: About so many different labelled texts of a language are learned from, whole: those whose hash
#: lies in the matching share of the hash range.
SAMPLE = 1500
#: Smallest share of a language's letters in a script that makes it a candidate there.
IN_SCRIPT = 0.01
#: Code points scored at once, and words labelled at once (or one text, if it is longer).
CHARS, WORDS = 1 << 20, 1 << 20
#: First code points of scripts; each goes on until the next.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})


@cache
def _categories() -> np.ndarray:
    """1 for a letter, 2 for a mark, 0 for every other code point, of all planes."""
    kinds = (unicodedata.category(chr(i))[0] for i in range(0x110000))
    return np.fromiter((1 if k == "L" else 2 if k == "M" else 0 for k in kinds), np.uint8, 0x110000)


class Reader:
    """Finds the words of many texts at once, and the places of their n-grams."""

    def __init__(self):
        self.kinds = _categories()
        low = [c.lower() for c in map(chr, range(0x10000))]
        self.low = np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.uint32)
        self.starts = np.array([s for s, _ in SCRIPTS])
        self.scripts = np.array([NAMES.index(n) for _, n in SCRIPTS])

    def words(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Code points (lower case, blanks between words), text of every word, first and one past
        the last code point of every word in the joined texts, script of every word."""
        joined = " " + " ".join(texts) + " "
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        far = points > 0xFFFF
        clipped = np.where(far, 0, points)
        kind = self.kinds[points]
        letter, mark = kind == 1, kind == 2
        if mark.any():  # a mark goes on with a word, but begins none
            at = np.arange(len(points))
            last = [np.maximum.accumulate(np.where(kind == k, at, -1)) for k in (0, 1)]
            letter |= mark & (last[1] > last[0])
        low = np.where(letter, np.where(far, points, self.low[clipped]), 32).astype(np.uint64)
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        first, end = edge[::2], edge[1::2]
        offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
        text_of = np.searchsorted(offsets, first, "right") - 1
        script = self.scripts[np.searchsorted(self.starts, points[first], "right") - 1]
        return low, text_of, first, end, script

    def grams(self, low: np.ndarray):
        """For every length: the positions of the n-grams inside words with their borders, each
        the position of a letter of the word, and the places."""
        letter = low != 32
        h = np.zeros(len(low), np.uint64)
        for n in range(1, ORDER + 1):
            size = len(low) - n + 1
            if size <= 0:  # a batch of next to nothing
                break
            h = h[:size] * np.uint64(0x100000001B3) + low[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)
            if n == 1:
                continue
            inner = np.ones(size, bool)
            for k in range(1, n - 1):
                inner &= letter[k : k + size]
            if n == 2:
                inner = letter[:-1] | letter[1:]
            at = np.flatnonzero(inner)
            place = (h[at] ^ (h[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            place = (place >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
            yield (np.where(letter[at], at, at + 1) if n == 2 else at + 1), place


def _slices(texts: list[str], most: int):
    """Neighbouring texts with together about ``most`` code points."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        total += len(t) + 1
        if total >= most:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict:
    """Log-probabilities of n-gram places by language, and the languages of every script.

    Copies of a text count once; rows without text or language are left out. What comes to the
    driver is bounded by languages times feature places. Without labelled rows there are no
    languages, and every prediction is ``und``.
    """
    known = labelled.select(labelled[text].alias("text"), labelled[lang].cast("string").alias("lang"))
    known = known.dropna().withColumn("h", F.xxhash64("text"))
    counts = known.select("lang", "h").distinct().groupBy("lang").count().collect()
    part = F.lit(False)
    for r in counts:
        top = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, sample / r["count"])))
        part = part | ((F.col("lang") == r["lang"]) & (F.col("h") <= top))
    chosen = known.filter(part).dropDuplicates(["lang", "h"])

    def make():
        reader = Reader()

        def run(b):
            out = {"lang": [], "kind": [], "place": [], "n": []}
            by: dict[str, list[str]] = {}
            for t, name in zip(b["text"], b["lang"]):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                features = np.zeros(1 << FEATURE_BITS, np.int64)
                letters = np.zeros(len(NAMES), np.int64)
                for i, j in _slices(texts, CHARS):
                    low, _, first, end, script = reader.words(texts[i:j])
                    np.add.at(letters, script, end - first)
                    for _, place in reader.grams(low):
                        features += np.bincount(place, minlength=len(features))
                for kind, values in (("gram", features), ("script", letters)):
                    at = np.flatnonzero(values)
                    out["lang"] += [name] * len(at)
                    out["kind"] += [kind] * len(at)
                    out["place"] += at.tolist()
                    out["n"] += values[at].tolist()
            return out

        return run

    rows = by_batch(chosen.select("text", "lang"), make, "lang string, kind string, place int, n long")
    rows = rows.groupBy("lang", "kind", "place").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    grams, letters = np.full((1 << FEATURE_BITS, len(langs)), 0.5), np.zeros((len(NAMES), len(langs)))
    at = rows["lang"].map({n: i for i, n in enumerate(langs)}).to_numpy(np.int64)
    place, n, is_gram = rows["place"].to_numpy(), rows["n"].to_numpy(), (rows["kind"] == "gram").to_numpy()
    grams[place[is_gram], at[is_gram]] += n[is_gram]
    letters[place[~is_gram], at[~is_gram]] += n[~is_gram]
    share = letters / np.maximum(letters.sum(axis=0, keepdims=True), 1)
    return {
        "langs": langs,
        "grams": np.log(grams / grams.sum(axis=0, keepdims=True)),
        "scripts": share >= IN_SCRIPT,
    }


def word_scores(reader: Reader, model: dict, texts: list[str]):
    """Scores by word and language; a language that is not written in the word's script is out,
    unless no language is."""
    low, text_of, first, end, script = reader.words(texts)
    scores = np.zeros((len(first), len(model["langs"])), np.float32)
    word_of = np.zeros(len(low), np.int64)
    word_of[first] = 1
    word_of = np.cumsum(word_of) - 1
    for letter_at, place in reader.grams(low):
        word = word_of[letter_at]
        for k in range(scores.shape[1]):
            scores[:, k] += np.bincount(word, model["grams"][place, k], len(first))
    allowed = model["scripts"][script]
    allowed |= ~allowed.any(axis=1, keepdims=True)
    scores[~allowed] = -1e9
    return scores, text_of, first, end


def viterbi(scores: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """The best label of every word; ``sizes`` counts the words of each text, in order.

    All texts take a step at once, the longest ones last: a step keeps the better of staying in a
    language and coming from the best one at a cost.
    """
    n, langs = scores.shape
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    active = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left")
    came = np.zeros((n, langs), bool)
    best_before = np.zeros(n, np.int16)
    label = np.zeros(n, np.int16)
    value = np.zeros((len(sizes), langs))
    for t, m in enumerate(active):
        at = starts[:m] + t
        if t:
            v = value[:m]
            best = v.argmax(axis=1)
            jump = v[np.arange(m), best] - switch
            best_before[at] = best
            came[at] = jump[:, None] > v
            value[:m] = np.maximum(v, jump[:, None])
        value[:m] += scores[at]
    now = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        label[at] = now[:m]
        if t:
            now[:m] = np.where(came[at, now[:m]], best_before[at], now[:m])
    return label


def identify(
    docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text", spans: bool = True, row: str | None = None
) -> DataFrame:
    """(doc_id, row, lang_pred, score, spans), one row per row of ``docs``; ``row`` is the stored number
    in the column of that name, or else numbers the rows of the scan.

    ``spans`` lists start, end (code points, end exclusive) and language of neighbouring words of
    one label. ``lang_pred`` is the language with the most letters, the first by name among equals;
    ``score`` its share of the letters. A text that is null, empty or has no letters is ``und``
    with score 0 and no spans. Repeated rows get equal results.
    """
    langs = model["langs"]

    def make():
        reader = Reader()

        def judge(part, out):
            """Label the words of neighbouring texts and write down their results."""
            scores, text_of, first, end = (np.concatenate(c) for c in zip(*part))
            if not len(text_of):
                return
            base = int(text_of[0])
            text_of = text_of - base
            count = int(text_of[-1]) + 1
            label = viterbi(scores, np.bincount(text_of, minlength=count), SWITCH)
            letters = np.zeros((count, len(langs)))
            np.add.at(letters, (text_of, label), end - first)
            total = letters.sum(axis=1)
            best = letters.argmax(axis=1)
            for i in np.flatnonzero(total):
                out["lang_pred"][base + i] = langs[best[i]]
                out["score"][base + i] = float(letters[i, best[i]] / total[i])
            if spans:
                new = np.flatnonzero((label[1:] != label[:-1]) | (text_of[1:] != text_of[:-1])) + 1
                opens, closes = np.concatenate([[0], new]), np.concatenate([new, [len(label)]]) - 1
                for i, j in zip(opens, closes):
                    out["spans"][base + text_of[i]].append(
                        {"start": int(first[i]), "end": int(end[j]), "lang": langs[label[i]]}
                    )

        def run(b):
            texts = [t or "" for t in b["text"]]
            out = {"doc_id": b["doc_id"], "row": b[ROW], "lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts)}
            if spans:
                out["spans"] = [[] for _ in texts]
            part, held = [], 0
            for i, j in _slices(texts, CHARS) if langs else ():
                scores, text_of, first, end = word_scores(reader, model, texts[i:j])
                base = np.cumsum([1, *(len(t) + 1 for t in texts[i:j])])[text_of]
                part.append((scores, text_of + i, first - base, end - base))
                held += len(first)
                if held >= WORDS:
                    judge(part, out)
                    part, held = [], 0
            if part:
                judge(part, out)
            return out

        return run

    schema = "doc_id long, row long, lang_pred string, score double"
    if spans:
        schema += ", spans array<struct<start: long, end: long, lang: string>>"
    rows, number = (numbered(docs), F.col(ROW)) if row is None else (docs, docs[row])
    texts = rows.select(docs[id_col].cast("long").alias("doc_id"), number.alias(ROW), docs[text].alias("text"))
    return by_batch(texts, make, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of all documents; learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs, model, spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
