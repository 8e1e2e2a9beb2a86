"""Analytics over tables of experiment runs.

``by`` names the experiment key: every operator works for many experiments at once. ``ord`` is the
order of the runs and breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitekst.functions.scan import ordered_chunks, running

# Parameter grid, scores of a failed run, top-k, repeats, defaults, gate.
GRID_R, GRID_ALPHA, GRID_DROPOUT = (8, 16, 32), (16, 32, 64), (0.0, 0.1, 0.2)
FAILED_SCORE, FAILED_LOSS = 0.0, 999.0
TOP_CONFIGS = 5
NUM_RUNS, BASE_SEED = 3, 42
DEFAULT_CONFIG = {"r": 16, "alpha": 32, "dropout": 0.1}
DEFAULT_SIZE = 8000
PATIENCE, MIN_GAIN = 3, 0.001
COMPLETE = "COMPLETE"


def _values(values: tuple) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def param_grid(
    spark: SparkSession,
    r: tuple[int, ...] = GRID_R,
    alpha: tuple[int, ...] = GRID_ALPHA,
    dropout: tuple[float, ...] = GRID_DROPOUT,
) -> DataFrame:
    """All combinations with their names."""
    grid = (
        spark.range(1)
        .select(_values(r).alias("r"))
        .select("r", _values(alpha).alias("alpha"))
        .select("r", "alpha", _values(dropout).alias("dropout"))
    )
    name = F.concat(
        F.lit("r"), "r", F.lit("_a"), "alpha", F.lit("_d"), F.col("dropout").cast("string")
    )
    return grid.withColumn("config_name", name)


def runs_with_status(runs: DataFrame, scores: tuple[str, ...], losses: tuple[str, ...] = ()):
    """Failed runs stay as rows with zero scores and a loss of 999; ``failed`` is never null."""
    failed = F.coalesce(F.col("failed"), F.lit(False))
    fixed = {
        **{c: F.when(failed, FAILED_SCORE).otherwise(F.col(c)) for c in scores},
        **{c: F.when(failed, FAILED_LOSS).otherwise(F.col(c)) for c in losses},
    }
    return runs.withColumns({**fixed, "failed": failed})


def _valid(runs: DataFrame) -> DataFrame:
    """Runs that did not fail; a table without ``failed`` has none that did."""
    if "failed" not in runs.columns:
        return runs
    return runs.filter(~F.coalesce(F.col("failed"), F.lit(False)))


def learning_curve(
    runs: DataFrame,
    by: tuple[str, ...] = (),
    metrics: tuple[str, ...] = ("test_bleu", "test_chrf"),
) -> DataFrame:
    """One line per run and metric, failed runs left out, by training size."""
    ids = [*by, "data_size", "ord"]
    long = _valid(runs).unpivot(ids, list(metrics), "metric", "value")
    return long.orderBy(*by, "metric", "data_size", "ord")


def best_run(
    runs: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = (), score: str = "test_bleu"
) -> DataFrame:
    """The first run that did not fail with the highest score above zero; no row when there is none."""
    first_best = F.max_by(
        F.struct(score, "ord", *columns), F.struct(F.col(score), -F.col("ord"))
    )
    found = _valid(runs).filter(F.col(score) > 0).groupBy(*by).agg(first_best.alias("best"))
    return found.filter("best is not null").select(*by, "best.*")


def top_configs(
    runs: DataFrame,
    k: int = TOP_CONFIGS,
    by: tuple[str, ...] = (),
    score: str = "test_bleu",
    completed: bool = False,
) -> DataFrame:
    """The k highest scores of runs that did not fail, ties by order.

    ``completed`` keeps trials whose ``state`` is COMPLETE only, so that pruned ones do not rank. With ``by``, tasks keep only k rows per key before the exchange, so a hot key stays small.
    """
    order = [F.col(score).desc(), F.col("ord").asc()]
    runs = _valid(runs)
    if completed:
        runs = runs.filter(F.col("state") == COMPLETE)
    if not by:
        return runs.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return runs.withColumn("rank", rank).filter(F.col("rank") <= k)


def score_heatmap(
    runs: DataFrame,
    by: tuple[str, ...] = (),
    index: str = "alpha",
    column: str = "r",
    values: tuple = GRID_R,
    score: str = "test_bleu",
) -> DataFrame:
    """Mean score, rows ``index`` by columns ``column``."""
    cells = [
        F.avg(F.when(F.col(column) == v, F.col(score))).alias(f"{column}_{v}") for v in values
    ]
    return _valid(runs).groupBy(*by, index).agg(*cells)


def config_summary(
    runs: DataFrame, config: str = "config_id", by: tuple[str, ...] = (), digits: int = 4
) -> DataFrame:
    """Mean, sample deviation, extremes per configuration, rounded half to even.

    Scaled and rounded in binary, as table libraries do it; decimal rounding differs in ties.
    """

    def rounded(value: Column, name: str) -> Column:
        return (F.rint(value * 10.0**digits) / 10.0**digits).alias(name)

    return (
        _valid(runs)
        .groupBy(*by, config)
        .agg(
            rounded(F.avg("test_bleu"), "bleu_mean"),
            rounded(F.stddev_samp("test_bleu"), "bleu_std"),
            rounded(F.min("test_bleu"), "bleu_min"),
            rounded(F.max("test_bleu"), "bleu_max"),
            rounded(F.avg("test_chrf"), "chrf_mean"),
            rounded(F.stddev_samp("test_chrf"), "chrf_std"),
        )
    )


def trial_summary(
    trials: DataFrame, by: tuple[str, ...] = (), state: str = "state"
) -> DataFrame:
    """Completed, pruned and all trials, and the share of pruned ones in percent."""
    pruned = F.count_if(F.col(state) == "PRUNED")
    return trials.groupBy(*by).agg(
        F.count_if(F.col(state) == COMPLETE).alias("completed"),
        pruned.alias("pruned"),
        F.count("*").alias("total"),
        (F.try_divide(pruned, F.count("*")) * 100).alias("pruned_percent"),
    )


def pareto_front(
    runs: DataFrame, x: str, y: str, by: tuple[str, ...] = ()
) -> DataFrame:
    """(by, x, y, ord) of runs that no other run beats on both scores; first of equal ones.

    Going down x, a point stays when its y is above every y before it. The running maximum goes
    over range-partitioned chunks, so one experiment may hold most of the rows.
    """
    by = list(by)
    points = runs.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(
        F.min("ord").alias("ord")
    )
    order = [F.col("x").desc(), F.col("y").desc()]
    chunked = ordered_chunks(points, by, order)
    marked = running(chunked, by, order, maxima={"above": F.col("y")}, inclusive=False)
    return marked.filter(F.col("above").isNull() | (F.col("y") > F.col("above"))).select(
        *by, F.col("x").alias(x), F.col("y").alias(y), "ord"
    )


def best_overall(runs: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The first run that did not fail with the largest x + y."""
    pick = F.max_by(F.struct(x, y, "ord"), F.struct(F.col(x) + F.col(y), -F.col("ord")))
    return _valid(runs).groupBy(*by).agg(pick.alias("p")).filter("p is not null").select(*by, "p.*")


def comparison_rows(report: DataFrame, ids: tuple[str, ...] = ()) -> DataFrame:
    """(label, value) lines of a wide report."""
    values = [c for c in report.columns if c not in ids]
    doubles = report.select(*ids, *[F.col(c).cast("double").alias(c) for c in values])
    return doubles.unpivot(list(ids), values, "label", "value")


def choose_config(
    stage2: DataFrame, grid: DataFrame, default: dict | None = None, columns=("r", "alpha", "dropout")
) -> DataFrame:
    """The first that exists: best of stage 2, best of the grid, the default. Inputs have at most
    one row each."""
    default = default or DEFAULT_CONFIG
    spark = stage2.sparkSession
    fallback = spark.range(1).select(*[F.lit(default[c]).alias(c) for c in columns])
    ranked = None
    for priority, (name, df) in enumerate(
        [("stage2", stage2), ("gridsearch", grid), ("default", fallback)]
    ):
        part = df.select(
            *columns, F.lit(name).alias("config_source"), F.lit(priority).alias("priority")
        )
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.agg(
        F.min_by(F.struct(*columns, "config_source"), "priority").alias("c")
    ).select("c.*")


def recommended_size(best: DataFrame, default: int | Column = DEFAULT_SIZE) -> Column:
    """Training size of the best run of the scaling experiment, else the default (a scalar)."""
    size = best.agg(F.max("data_size")).scalar()
    return F.coalesce(size, default if isinstance(default, Column) else F.lit(default))


def validation_runs(
    top: DataFrame, runs: int = NUM_RUNS, base_seed: int = BASE_SEED
) -> DataFrame:
    """Each top configuration repeated with its run number and seed."""
    run = _values(tuple(range(runs)))
    return top.select("*", run.alias("run")).withColumn("seed", F.col("run") + base_seed)


def early_stop(
    evals: DataFrame,
    run: str = "run_id",
    step: str = "step",
    metric: str = "eval_bleu",
    patience: int = PATIENCE,
    min_gain: float = MIN_GAIN,
) -> DataFrame:
    """Per run: where training would stop, and its best checkpoint up to there.

    An evaluation counts as a gain when it beats the best so far by more than ``min_gain``;
    ``patience`` evaluations in a row without gain stop the run. "Best so far" and "evaluations
    since the last gain" are running maxima, computed in chunks: a run may be of any length.
    """
    by, order = [run], [F.col(step)]
    rows = evals.filter(F.col(metric).isNotNull()).select(run, step, metric)
    chunked = ordered_chunks(rows, by, order)
    point = F.struct(F.col(metric).alias("value"), (-F.col(step)).alias("neg_step"))
    seen = running(
        chunked, by, order, maxima={"before": F.col(metric)}, sums={"n": F.lit(1)}, inclusive=False
    )
    gain = F.col("before").isNull() | (F.col(metric) - F.col("before") > min_gain)
    flagged = seen.withColumns({"n": F.col("n") + 1, "gain_at": F.when(gain, F.col("n") + 1)})
    audited = running(
        flagged, by, order, maxima={"last_gain": F.col("gain_at"), "best": point}
    ).withColumn("stale", F.col("n") - F.col("last_gain"))
    state = F.struct("best", "n", step)
    stops = F.col("stale") >= patience
    return (
        audited.groupBy(run)
        .agg(
            F.min_by(F.when(stops, state), F.when(stops, F.col(step))).alias("stop"),
            F.max_by(state, step).alias("last"),
        )
        .select(
            run,
            F.col("stop").isNotNull().alias("stopped_early"),
            F.coalesce(F.col("stop")[step], F.col("last")[step]).alias("last_step"),
            F.coalesce("stop.n", "last.n").alias("evaluations"),
            (-F.coalesce("stop.best.neg_step", "last.best.neg_step")).alias("best_step"),
            F.coalesce("stop.best.value", "last.best.value").alias("best_metric"),
        )
    )


def final_report(
    config: DataFrame, validation: DataFrame, test: DataFrame, splits: DataFrame
) -> DataFrame:
    """Configuration, validation and test metrics and dataset sizes in one record.

    ``config``, ``validation`` and ``test`` are one-line tables; ``splits`` has a ``split`` column.
    """

    def record(df: DataFrame) -> Column:
        return df.select(F.struct(*df.columns)).scalar()

    def rows_of(name: str) -> Column:
        return F.count_if(F.col("split") == name).alias(name)

    sizes = splits.agg(rows_of("train"), rows_of("val"), rows_of("test"))
    return sizes.select(
        record(config).alias("configuration"),
        record(validation).alias("validation_metrics"),
        record(test).alias("test_metrics"),
        F.struct("train", "val", "test").alias("dataset_sizes"),
    )
