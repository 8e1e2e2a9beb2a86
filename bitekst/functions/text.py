"""Whitespace, words and word-boundary helpers with one definition of both classes.

Regular-expression shorthands differ between engines and Java releases (``\\s`` without Unicode,
``\\b`` since Java 19), so the classes are written out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace, and as part of a word.
WHITESPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Whitespace without line breaks.
BLANK = WHITESPACE.replace(r"\t-\r", r"\t\x0b\x0c")
WORD = r"\p{L}\p{N}_"

SPACES = f"[{WHITESPACE}]+"
PIECES = f"[{WORD}]+|[^{WORD}]+"


# The same characters one by one; those that Python's ``str`` methods take for white space, too.
SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def clean(col: Column) -> Column:
    """Strip and turn every run of whitespace into one space."""
    return F.trim(F.regexp_replace(col, SPACES, " "))


def squeeze(col: Column) -> Column:
    """Remove all whitespace."""
    return F.regexp_replace(col, SPACES, "")


def words(col: Column) -> Column:
    return F.array_remove(F.split(col, SPACES), "")


def word_count(col: Column) -> Column:
    return F.size(words(col)).cast("long")


def pieces(col: Column) -> Column:
    """The text cut at every word boundary: runs of word and of non-word characters in turn."""
    return F.regexp_extract_all(col, F.lit(PIECES), F.lit(0))


def starts_with_word(col: Column) -> Column:
    return F.rlike(col, F.lit(rf"\A[{WORD}]"))


def ends_with_word(col: Column) -> Column:
    return F.rlike(col, F.lit(rf"[{WORD}]\z"))


def whole_word_pattern(term: Column) -> Column:
    """Case-insensitive pattern that finds ``term`` between two word boundaries.

    A boundary next to a word character means "no word character outside"; next to any other
    character it means "a word character outside".
    """
    quoted = F.regexp_replace(term, rf"([^{WORD}])", r"\\$1")
    left = F.when(starts_with_word(term), rf"(?<![{WORD}])").otherwise(rf"(?<=[{WORD}])")
    right = F.when(ends_with_word(term), rf"(?![{WORD}])").otherwise(rf"(?=[{WORD}])")
    return F.concat(F.lit("(?iu)"), left, quoted, right)


def literal_replacement(col: Column) -> Column:
    """Protect the two characters that mean something in a replacement string."""
    return F.regexp_replace(col, r"([\\$])", r"\\$1")
