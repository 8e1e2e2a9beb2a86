"""Experiment tracking tables (parameters, metrics, tags) and the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitekst.operators.terminology import override
from bitekst.session import materialize, path_exists

# The score a model must exceed to be promoted, the first version, time formats.
PROMOTION_BLEU = 0.45
FIRST_VERSION = "v1.0"
ID_TIME_FORMAT = "yyyyMMdd_HHmmss"
ISO_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


# Opens one level of nested objects after the other; lists and plain values are leaves. A variant cannot
# be handed on, its JSON text can.
_FLATTEN = """
with recursive tree(id, path, value, nested) max recursion level {depth} as (
  select `{row_id}`, '', `{config}`, true from {{configs}}
  union all
  select t.id, case when t.path = '' then e.key else concat(t.path, :sep, e.key) end,
    case when schema_of_variant(e.value) rlike '^(OBJECT|ARRAY)' then to_json(e.value) else cast(e.value as string) end,
    startswith(schema_of_variant(e.value), 'OBJECT')
  from tree t, lateral variant_explode(parse_json(t.value)) e where t.nested)
select id as `{row_id}`, path, value from tree where not nested limit all
"""


def flatten_config(configs: DataFrame, row_id: str, config: str, sep: str = ".", depth: int = 1000) -> DataFrame:
    """(row_id, path, value): dotted path of every leaf of a JSON document per row.

    Objects are entered, lists stay values, an empty object gives nothing. One recursive query, a step
    for each level that the deepest document has; a document of more than ``depth`` levels is an error.
    """
    query = _FLATTEN.format(row_id=row_id, config=config, depth=depth)
    return configs.sparkSession.sql(query, args={"sep": sep}, configs=configs)


def latest_metrics(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Last value of each metric of each run; log(run, key, value, step, ord)."""
    newest = F.max_by(F.struct("value", "step"), F.struct("step", "ord"))
    return log.groupBy(run, "key").agg(newest.alias("m")).select(
        run, "key", "m.value", "m.step"
    )


def merged_tags(experiment_tags: Column, run_tags: Column) -> Column:
    """Tags of the experiment, overridden by tags of the run."""
    empty = F.create_map().cast("map<string,string>")
    return override(F.coalesce(experiment_tags, empty), F.coalesce(run_tags, empty))


def log_experiment(
    params: DataFrame, metrics: DataFrame, artifacts: DataFrame, run: str = "run_id"
) -> DataFrame:
    """One long table (run, kind, key, value) from params, metrics(step) and artifacts(name, path)."""
    parts = [
        params.select(run, F.lit("param").alias("kind"), F.col("path").alias("key"), "value"),
        metrics.select(
            run, F.lit("metric").alias("kind"), "key", F.col("value").cast("string").alias("value")
        ),
        artifacts.select(
            run, F.lit("artifact").alias("kind"), F.col("name").alias("key"),
            F.col("path").alias("value"),
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def register_model(
    runs: DataFrame,
    name: str | Column,
    root: str,
    time: Column | None = None,
    experiment: str = "experiment",
    metrics: tuple[str, ...] = (),
    config: tuple[str, ...] = (),
    description: str | Column = "",
) -> DataFrame:
    """Registry rows: id (name and time), name, experiment, timestamp, description, path, and the
    metrics and the configuration as maps of texts.

    Metrics and parameters are named columns of ``runs``; the columns of ``runs`` stay.
    """
    name = name if isinstance(name, Column) else F.lit(name)
    stamp = F.date_format(F.current_timestamp() if time is None else time, ID_TIME_FORMAT)
    model_id = F.concat_ws("_", name, stamp)
    return runs.withColumns(
        {
            "id": model_id,
            "name": name,
            "timestamp": stamp,
            "description": description if isinstance(description, Column) else F.lit(description),
            "path": F.concat_ws("/", F.lit(root), F.col(experiment), model_id, F.lit("model")),
            "metrics": _as_map(metrics),
            "config": _as_map(config),
        }
    )


def _as_map(columns: tuple[str, ...]) -> Column:
    entries = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return F.create_map(*entries).cast("map<string,string>")


def append_models(models: DataFrame, path: str, experiment: str = "experiment") -> None:
    """Add registry rows to the registry at ``path``; a model id that is there already is not
    added again."""
    columns = ["id", "name", experiment, "timestamp", "description", "path", "metrics", "config"]
    rows = models.select(*columns).dropDuplicates(["id"])
    known = read_models(models.sparkSession, path)
    if known is not None:
        rows = materialize(rows.join(known.select("id"), "id", "left_anti"))
    rows.write.mode("append").parquet(path)


def read_models(spark: SparkSession, path: str) -> DataFrame | None:
    """The registry at ``path``; nothing if nothing is there yet. One that cannot be read is an error."""
    return spark.read.parquet(path) if path_exists(spark, path) else None


def promote_model(
    models: DataFrame,
    requests: DataFrame,
    version: str = FIRST_VERSION,
    score: str = "test_bleu",
    above: float = PROMOTION_BLEU,
) -> DataFrame:
    """requests(model_id, promoted_at) that name a registered model above the gate.

    Append the result to the promotion history. Unknown ids are what :func:`unknown_models` lists.
    """
    good = models.filter(F.col(score) > above).select(F.col("id").alias("model_id"), "path")
    return requests.join(good, "model_id").select(
        "model_id",
        F.lit(version).alias("version"),
        "path",
        F.date_format("promoted_at", ISO_TIME_FORMAT).alias("promoted_at"),
    )


def unknown_models(models: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests for models that are not registered."""
    return requests.join(models.select(F.col("id").alias("model_id")), "model_id", "left_anti")


def set_production(
    models: DataFrame, model_id: str, promoted_at: Column | None = None, version=FIRST_VERSION
) -> DataFrame:
    """Promotion row of one model; an unknown id is an error."""
    chosen = models.filter(F.col("id") == model_id).limit(1)
    if chosen.isEmpty():
        raise ValueError(f"Model {model_id} not found")
    time = F.current_timestamp() if promoted_at is None else promoted_at
    return chosen.select(
        F.col("id").alias("model_id"),
        F.lit(version).alias("version"),
        "path",
        F.date_format(time, ISO_TIME_FORMAT).alias("promoted_at"),
    )


def current_production(promotions: DataFrame) -> DataFrame:
    """The latest promotion."""
    row = F.struct(*promotions.columns)
    latest = promotions.agg(F.max_by(row, F.struct("promoted_at", "model_id")).alias("p"))
    return latest.filter("p is not null").select("p.*")
