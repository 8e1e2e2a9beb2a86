"""Tokeniser and closed formulas of the two string metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitekst.functions.text import SPACES

# The public mteval-13a rules, in order. The space is left out of the first one, which
# would only put further spaces beside it.
TOKEN_REMOVALS = [("<skipped>", ""), ("-\n", ""), ("\n", " ")]
TOKEN_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]
TOKEN_RULES = [
    (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]

# N-gram orders and the weight of recall.
WORD_ORDER = 4
CHAR_ORDER = 6
CHRF_BETA = 2


def tokens(col: Column) -> Column:
    """Metric tokens of a text; case is kept."""
    for entity, char in [*TOKEN_REMOVALS, *TOKEN_ENTITIES]:
        col = F.replace(col, F.lit(entity), F.lit(char))
    col = F.concat(F.lit(" "), col, F.lit(" "))
    for pattern, replacement in TOKEN_RULES:
        col = F.regexp_replace(col, pattern, replacement)
    return F.array_remove(F.split(col, SPACES), "")


_SIGNS = [c for c in map(chr, range(128)) if re.match(TOKEN_RULES[0][0], c)]
_NUMBERS = [
    (signs, re.compile(pattern), replacement.replace("$", "\\"))
    for signs, (pattern, replacement) in zip((".,", ".,", "-"), TOKEN_RULES[1:])
]


def token_list(text: str) -> list[str]:
    """The same as :func:`tokens`, inside a task; rules are tried where their signs occur."""
    for old, new in TOKEN_REMOVALS:
        text = text.replace(old, new)
    if "&" in text:
        for entity, char in TOKEN_ENTITIES:
            text = text.replace(entity, char)
    for sign in _SIGNS:
        if sign in text:
            text = text.replace(sign, f" {sign} ")
    text = f" {text} "
    for signs, pattern, replacement in _NUMBERS:
        if any(sign in text for sign in signs):
            text = pattern.sub(replacement, text)
    return text.split()


def _sum(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def with_bleu(df: DataFrame, precisions: bool = False) -> DataFrame:
    """Add unsmoothed ``bleu`` in 0..1 (and ``bleu_1..4``) to ``match_n``, ``hyp_n``, ``ref_n``.

    0 when a precision is 0 or one side is empty; the lengths are the counts of order 1.
    """
    orders = range(1, WORD_ORDER + 1)
    share = {n: f"coalesce(try_divide(match_{n}, hyp_{n}), 0D)" for n in orders}
    logs = _sum([f"ln({share[n]})" for n in orders])
    least = ", ".join(f"match_{n}" for n in orders)
    short = "if(hyp_1 > ref_1, 1D, exp(1 - ref_1 / hyp_1))"
    bleu = (
        f"if(least({least}) > 0 and ref_1 > 0, {short} * exp({logs} / {WORD_ORDER}), 0D) as bleu"
    )
    shares = [f"{share[n]} as bleu_{n}" for n in orders] if precisions else []
    return df.selectExpr("*", bleu, *shares)


def with_chrf(df: DataFrame) -> DataFrame:
    """Add ``chrf`` in 0..100 to ``c_match_n``, ``c_hyp_n``, ``c_ref_n``.

    Precision and recall are means over the orders that both sides have.
    """
    orders = range(1, CHAR_ORDER + 1)
    both = {n: f"(c_hyp_{n} > 0 and c_ref_{n} > 0)" for n in orders}
    count = _sum([f"int({both[n]})" for n in orders])

    def mean(side: str) -> str:
        return _sum([f"if({both[n]}, c_match_{n} / c_{side}_{n}, 0D)" for n in orders]) + f" / {count}"

    weight = CHRF_BETA**2
    staged = df.selectExpr(
        "*", f"if({count} > 0, struct({mean('hyp')} as p, {mean('ref')} as r), null) as _f"
    )
    score = f"100 * (1 + {weight}) * _f.p * _f.r / ({weight} * _f.p + _f.r)"
    return staged.selectExpr("*", f"if(_f.p + _f.r > 0, {score}, 0D) as chrf").drop("_f")
