"""Corpus and row scores, error classes, score distribution, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitekst.functions import scores, text
from bitekst.functions.ngrams import all_stats, char_stats, word_stats
from bitekst.functions.quantiles import quantiles
from bitekst.session import materialize

WORD_ORDERS = range(1, scores.WORD_ORDER + 1)
CHAR_ORDERS = range(1, scores.CHAR_ORDER + 1)

# Limits of the error report.
LOW_BLEU = 0.5
WORST_ROWS = 100
SHORT_RATIO, LONG_RATIO, SHARED_RATIO = 0.5, 1.5, 0.5


def strip_outputs(df: DataFrame, hyp: str = "prediction", ref: str = "reference") -> DataFrame:
    """Strip whitespace round predictions and references, nothing inside."""
    return df.withColumns({hyp: text.strip(F.col(hyp)), ref: text.strip(F.col(ref))})


def _guarded(rows: DataFrame) -> DataFrame:
    """The prediction counts only in those character orders that the reference has."""
    return rows.withColumns(
        {f"c_hyp_{n}": F.expr(f"if(c_ref_{n} > 0, c_hyp_{n}, 0)") for n in CHAR_ORDERS}
    )


def ngram_matches(
    df: DataFrame, row_id="pair_id", hyp="prediction", ref="reference", keep=()
) -> DataFrame:
    """Per row and order 1..4: clipped matches and possible n-grams, and both lengths."""
    rows = word_stats(df, row_id, hyp, ref, tuple(keep))
    return rows.selectExpr(
        row_id,
        *keep,
        *[f"match_{n}" for n in WORD_ORDERS],
        *[f"hyp_{n} as possible_{n}" for n in WORD_ORDERS],
        "hyp_1 as hyp_len",
        "ref_1 as ref_len",
    )


def bleu_sentence(
    df: DataFrame, row_id="pair_id", hyp="prediction", ref="reference", keep=()
) -> DataFrame:
    rows = word_stats(df, row_id, hyp, ref, tuple(keep))
    return scores.with_bleu(rows).select(row_id, *keep, "bleu")


def chrf_sentence(
    df: DataFrame, row_id="pair_id", hyp="prediction", ref="reference", keep=()
) -> DataFrame:
    rows = _guarded(char_stats(df, row_id, hyp, ref, tuple(keep)))
    return scores.with_chrf(rows).select(row_id, *keep, "chrf")


def row_scores(
    df: DataFrame, row_id="pair_id", hyp="prediction", ref="reference", keep=()
) -> DataFrame:
    """BLEU and chrF of every row, in one pass and without moving texts."""
    rows = scores.with_bleu(_guarded(all_stats(df, row_id, hyp, ref, tuple(keep))))
    return scores.with_chrf(rows).select(row_id, *keep, "bleu", "chrf")


BLEU_COLUMNS = ["bleu", *[f"bleu_{n}" for n in WORD_ORDERS]]


def _sums(names: list[str], orders: range) -> list[Column]:
    columns = [f"{p}_{n}" for p in names for n in orders]
    return [F.expr(f"coalesce(sum({c}), 0) as {c}") for c in columns]


def bleu_corpus(
    df: DataFrame, row_id="pair_id", hyp="prediction", ref="reference", by=()
) -> DataFrame:
    """BLEU from pooled counts, one line per value of ``by``."""
    rows = word_stats(df, row_id, hyp, ref, tuple(by))
    pooled = rows.groupBy(*by).agg(*_sums(["match", "hyp", "ref"], WORD_ORDERS))
    return scores.with_bleu(pooled, precisions=True).select(*by, *BLEU_COLUMNS)


def chrf_corpus(
    df: DataFrame, row_id="pair_id", hyp="prediction", ref="reference", by=()
) -> DataFrame:
    rows = _guarded(char_stats(df, row_id, hyp, ref, tuple(by)))
    pooled = rows.groupBy(*by).agg(*_sums(["c_match", "c_hyp", "c_ref"], CHAR_ORDERS))
    return scores.with_chrf(pooled).select(*by, "chrf")


def score_summary(df: DataFrame, score: str = "score", by=()) -> DataFrame:
    """System value and population deviation of a supplied score column; 0, 0 without rows."""
    return df.groupBy(*by).agg(*_summary(score))


def _summary(score: str) -> list[Column]:
    return [
        F.coalesce(F.avg(score), F.lit(0.0)).alias("comet"),
        F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("comet_std"),
    ]


def evaluate_all(
    df: DataFrame,
    row_id="pair_id",
    hyp="prediction",
    ref="reference",
    by=(),
    score: str | None = None,
) -> DataFrame:
    """Strip, then BLEU, chrF and (when a score column is supplied) its summary, in one pass."""
    by = tuple(by)
    stripped = strip_outputs(df, hyp, ref)
    kept = by if score is None or score in by else (*by, score)
    rows = _guarded(all_stats(stripped, row_id, hyp, ref, kept))
    sums = _sums(["match", "hyp", "ref"], WORD_ORDERS)
    sums += _sums(["c_match", "c_hyp", "c_ref"], CHAR_ORDERS)
    summary = [] if score is None else _summary(score)
    pooled = scores.with_chrf(scores.with_bleu(rows.groupBy(*by).agg(*sums, *summary), precisions=True))
    extra = [] if score is None else ["comet", "comet_std"]
    return pooled.select(*by, *BLEU_COLUMNS, "chrf", *extra)


def beside(parts: list[DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """Put reports with one line per value of ``by`` (or just one line) next to each other."""
    out = parts[0]
    for part in parts[1:]:
        if by:
            out = out.join(part, list(by))
        else:
            line = part.select(F.struct(*part.columns)).scalar()
            out = out.withColumns({c: line[c] for c in part.columns})
    return out


def error_class(hyp: Column, ref: Column) -> Column:
    h, r = text.words(hyp), text.words(ref)
    n_hyp, n_ref = F.size(h), F.size(r)
    shared = F.size(F.array_intersect(h, r))
    return (
        F.when(n_hyp < n_ref * SHORT_RATIO, "under_generation")
        .when(n_hyp > n_ref * LONG_RATIO, "over_generation")
        .when(shared < F.size(F.array_distinct(r)) * SHARED_RATIO, "semantic_drift")
        .otherwise("minor_error")
    )


def classify_error(
    df: DataFrame, row_id="pair_id", hyp="prediction", ref="reference"
) -> DataFrame:
    return df.select(row_id, error_class(F.col(hyp), F.col(ref)).alias("error_type"))


def error_samples(
    df: DataFrame,
    row_id="pair_id",
    src="source",
    hyp="prediction",
    ref="reference",
    below: float = LOW_BLEU,
    top: int = WORST_ROWS,
) -> DataFrame:
    """The lowest-scored rows with texts and error class.

    The rows are chosen by BLEU; texts are fetched, and chrF counted, for the listed rows only.
    ``row_id`` must be unique.
    """
    worst = (
        bleu_sentence(df, row_id, hyp, ref)
        .filter(F.col("bleu") < below)
        .orderBy("bleu", row_id)
        .limit(top)
    )
    listed = df.select(row_id, src, hyp, ref).join(F.broadcast(worst), row_id)
    rows = _guarded(char_stats(listed, row_id, hyp, ref, tuple({src, hyp, ref, "bleu"})))
    return scores.with_chrf(rows).select(
        row_id,
        F.col(src).alias("source"),
        F.col(hyp).alias("prediction"),
        F.col(ref).alias("reference"),
        "bleu",
        "chrf",
        error_class(F.col(hyp), F.col(ref)).alias("error_type"),
    ).orderBy("bleu", row_id)


def error_class_counts(samples: DataFrame) -> DataFrame:
    """Number of listed rows and mean scores per error class."""
    return samples.groupBy("error_type").agg(
        F.count("*").alias("rows"), F.avg("bleu").alias("bleu"), F.avg("chrf").alias("chrf")
    )


def score_distribution(
    rows: DataFrame, score: str = "bleu", low: float = 0.0, high: float = 1.0
) -> DataFrame:
    """Mean, population deviation, extremes and interpolated quartiles; no row for no scores."""
    kept = materialize(rows.select(score))
    q = quantiles(kept, score, [0.25, 0.5, 0.75], low, high)
    stats = kept.agg(
        F.count("*").alias("rows"),
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
    ).filter("rows > 0")
    return stats.withColumn("q", q).select(
        "mean",
        "std",
        "min",
        "max",
        F.col("q")[1].alias("median"),
        F.col("q")[0].alias("q25"),
        F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"),
    )


def prediction_table(sources: DataFrame, outputs: DataFrame, row_id="pair_id") -> DataFrame:
    """Source, prediction and reference of each row, matched by id."""
    return sources.join(outputs, row_id).select(row_id, "source", "prediction", "reference")
