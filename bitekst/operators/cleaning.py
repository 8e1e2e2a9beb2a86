"""Text clean-up and sentence splitting; every function works inside one row."""

from __future__ import annotations

from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitekst.functions.text import BLANK, SPACES, WHITESPACE, WORD, strip

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = {
    "en": ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "No", "e.g", "i.e", "vs"),
    "no": ("bl.a", "ca", "dvs", "f.eks", "jf", "kl", "nr", "pst", "Dr"),
}

# Fewest words of a kept sentence, and the merge limit.
MIN_SENTENCE_WORDS = 3
MERGE_BELOW_WORDS = 5

_HELD = "\x01"

# White space that is neither a plain space nor a line break, or a held blank. The first class, of few
# ranges, leaves out nearly every character of a text before the exact one is tried.
_OTHER_BLANK = WHITESPACE.replace(r"\t-\r\x1c-\x20", r"\t\x0b-\r\x1c-\x1f") + r"\x01"
_UNCLEAN = rf"[^ -~\n\x{{a1}}-\x{{167f}}\x{{3001}}-\x{{10ffff}}](?<=[{_OTHER_BLANK}])"


def drop_dup_title(col: Column) -> Column:
    """Drop the first line when the second line contains it."""
    lines = F.split(strip(col), "\n")
    first, second = strip(F.get(lines, F.lit(0))), strip(F.get(lines, F.lit(1)))
    repeated = (first != "") & (second != "") & F.contains(second, first)
    rest = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    return F.when(repeated, rest).otherwise(col)


def split_sentences(
    col: Column, lang: str = "en", abbreviations: tuple[str, ...] | None = None
) -> Column:
    """Array of cleaned sentences of at least three words.

    A sentence ends at a line break, or at ``. ! ?`` (with closing quotes or brackets) before
    whitespace, unless a small letter follows or the stop belongs to an abbreviation. A line break
    behind an abbreviation ends the sentence.
    """
    abbreviations = ABBREVIATIONS[lang] if abbreviations is None else abbreviations
    body = drop_dup_title(col)
    if abbreviations:
        names = "|".join(a.replace(".", r"\.") for a in abbreviations)
        held = F.regexp_replace(
            body, rf"(\A|[^{WORD}])({names})\.[{BLANK}]", rf"$1$2.{_HELD}"
        )
        # looked for letter by letter first, in the text as it came: the body is a part of it
        found = reduce(or_, (F.contains(col, F.lit(f"{a}.")) for a in abbreviations))
        body = F.when(found, held).otherwise(body)
    body = F.regexp_replace(
        body, rf"""([.!?]["')\]»”’]*){SPACES}([^\p{{Ll}}{WHITESPACE}])""", "$1\n$2"
    )
    # the whole text is cleaned before it is cut; then words lie one space apart
    body = F.regexp_replace(F.regexp_replace(body, _UNCLEAN, " "), "  +", " ")
    parts = F.transform(F.split(body, "\n"), lambda s: F.trim(s))
    spaces = lambda s: F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))
    return F.filter(parts, lambda s: spaces(s) >= MIN_SENTENCE_WORDS - 1)


def merge_short(sentences: Column, min_words: int = MERGE_BELOW_WORDS) -> Column:
    """Join neighbours while the joined text stays below ``min_words`` words; in one walk along the
    sentences of a row."""
    return _merged(sentences, F.lit(min_words))


# Rows whose sentences are Python objects at a time.
MERGED_AT_ONCE = 256


@F.arrow_udf(T.ArrayType(T.StringType()))
def _merged(sentences: pa.Array, least: pa.Array) -> pa.Array:
    def one(row, least):
        if row is None:
            return None
        groups, held = [[]], 0
        for sentence in row:
            words = len(sentence.split())  # the same white space as in ``word_count``
            if held + words >= least:
                groups.append([])
                held = 0
            groups[-1].append(sentence)
            held += words
        return [text for g in groups if (text := " ".join(g).strip())]

    parts = []
    for i in range(0, len(sentences), MERGED_AT_ONCE):
        cut = zip(*(x[i : i + MERGED_AT_ONCE].to_pylist() for x in (sentences, least)))
        parts.append(pa.array([one(*r) for r in cut], pa.list_(pa.string())))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))


def sentences(
    df: DataFrame,
    row_id: str,
    text: str,
    lang: str = "en",
    min_words: int = MERGE_BELOW_WORDS,
) -> DataFrame:
    """One row per merged sentence with its 0-based position."""
    split = df.select(row_id, split_sentences(F.col(text), lang).alias("s"))
    return split.select(
        row_id, F.posexplode(merge_short(F.col("s"), min_words)).alias("pos", "sentence")
    ).withColumn("pos", F.col("pos").cast("long"))
