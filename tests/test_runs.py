import json
import random

import pytest
from pyspark.sql import functions as F

from bitekst.operators import runs, tracking

SCHEMA = (
    "experiment string, ord long, config_id int, r int, alpha int, dropout double, "
    "data_size long, test_bleu double, test_chrf double, failed boolean"
)
ROWS = [
    ("a", 1, 0, 8, 16, 0.0, 100, 0.10, 30.0, False),
    ("a", 2, 0, 16, 16, 0.1, 500, 0.50, 40.0, False),
    ("a", 3, 1, 16, 32, 0.1, 1000, 0.50, 41.0, None),
    ("a", 4, 1, 32, 32, 0.2, 2000, 0.90, 99.0, True),
    ("a", 5, 2, 32, 64, 0.2, 4000, 0.30, 60.0, False),
    ("b", 6, 0, 8, 16, 0.0, 100, 0.0, 0.0, False),
]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_grid(spark):
    grid = runs.param_grid(spark)
    names = {r.config_name for r in grid.collect()}
    assert grid.count() == 27 and {"r8_a16_d0.0", "r32_a64_d0.2"} <= names


def test_failed_runs_are_kept_and_marked(table):
    fixed = {r.ord: r for r in runs.runs_with_status(table, ("test_bleu",)).collect()}
    assert fixed[4].test_bleu == 0.0 and fixed[4].failed is True
    assert fixed[3].test_bleu == 0.5 and fixed[3].failed is False


def test_learning_curve_leaves_failed_out(table):
    rows = runs.learning_curve(table, ("experiment",)).filter("metric = 'test_bleu'").collect()
    assert [r.ord for r in rows] == [1, 2, 3, 5, 6]


def test_best_run_is_the_first_of_the_highest(table):
    valid = table.filter("not coalesce(failed, false)")
    rows = runs.best_run(valid, ("r",), ("experiment",)).collect()
    assert [(r.experiment, r.ord, r.r) for r in rows] == [("a", 2, 16)]  # b has no score above 0
    assert runs.best_run(valid.filter("experiment = 'b'"), ("r",)).count() == 0


def test_top_keeps_ties_by_order(table):
    rows = runs.top_configs(table, 2, ("experiment",)).filter("experiment = 'a'").collect()
    assert [r.ord for r in sorted(rows, key=lambda r: r["rank"])] == [2, 3]
    assert [r.ord for r in runs.top_configs(table, 3).collect()] == [2, 3, 5]


def test_heatmap(table):
    rows = {r.alpha: r for r in runs.score_heatmap(table).collect()}
    assert rows[16].r_8 == pytest.approx(0.05) and rows[16].r_16 == 0.5 and rows[16].r_32 is None


def test_summary_uses_sample_deviation(table):
    rows = {r.config_id: r for r in runs.config_summary(table.filter("experiment = 'a'")).collect()}
    assert rows[0].bleu_std == pytest.approx(0.2828) and rows[0].bleu_mean == pytest.approx(0.3)
    assert rows[2].bleu_std is None  # one run


def test_trials(spark):
    df = spark.createDataFrame([("COMPLETE",), ("PRUNED",), ("PRUNED",), ("FAIL",)], "state string")
    assert tuple(runs.trial_summary(df).first()) == (1, 2, 4, 50.0)
    assert runs.trial_summary(df.filter("false")).first().pruned_percent is None


def plain_front(points):
    """A point stays unless another is at least as good on both scores; of equal ones the first."""
    out = set()
    for i, (x, y) in enumerate(points):
        beaten = any(
            (u >= x and v >= y) and ((u, v) != (x, y) or j < i)
            for j, (u, v) in enumerate(points)
            if j != i
        )
        if not beaten:
            out.add(i)
    return out


def test_pareto_against_brute_force(spark):
    rng = random.Random(9)
    points = [(rng.randint(0, 30) / 10, rng.randint(0, 30) / 10) for _ in range(400)]
    rows = [("hot", i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    rows += [("small", 1000, 1.0, 1.0), ("small", 1001, 1.0, 1.0), ("small", 1002, 0.5, 2.0)]
    df = spark.createDataFrame(rows, "e string, ord long, x double, y double").repartition(5)
    front = runs.pareto_front(df, "x", "y", ("e",)).collect()
    assert {r.ord for r in front if r.e == "hot"} == plain_front(points)
    assert {r.ord for r in front if r.e == "small"} == {1000, 1002}
    overall = {r.ord for r in runs.pareto_front(df, "x", "y").collect()}
    every = [(x, y) for _, _, x, y in rows]
    assert overall == {rows[i][1] for i in plain_front(every)}


def test_best_overall_is_the_first(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 1.0), (3, 0.0, 0.0)], "ord long, x double, y double")
    assert runs.best_overall(df, "x", "y").first().ord == 1


def test_config_choice(spark, table):
    cols = ("r", "alpha", "dropout")
    best, none = runs.best_run(table, cols), runs.best_run(table.filter("false"), cols)
    assert runs.choose_config(best, none).first().config_source == "stage2"
    assert runs.choose_config(none, best).first().config_source == "gridsearch"
    row = runs.choose_config(none, none).first()
    assert (row.config_source, row.r, row.alpha, row.dropout) == ("default", 16, 32, 0.1)


def test_recommended_size(spark, table):
    best = runs.best_run(table.filter("not coalesce(failed, false)"), ("data_size",))
    one = spark.range(1)
    assert one.select(runs.recommended_size(best)).first()[0] == 500
    assert one.select(runs.recommended_size(best.filter("false"))).first()[0] == 8000


def test_validation_runs(table):
    rows = runs.validation_runs(runs.top_configs(table, 2)).collect()
    assert sorted((r.ord, r.run, r.seed) for r in rows) == [
        (o, k, 42 + k) for o in (2, 3) for k in range(3)
    ]


def plain_stop(values, patience=3, gain=0.001):
    best, best_step, stale = None, None, 0
    for step, v in enumerate(values):
        stale = 0 if best is None or v - best > gain else stale + 1
        if best is None or v > best:
            best, best_step = v, step
        if stale >= patience:
            return True, step, best_step, best
    return False, len(values) - 1, best_step, best


def test_early_stop_against_a_loop(spark):
    rng = random.Random(4)
    logs = {i: [round(rng.random(), 2) for _ in range(rng.randint(1, 40))] for i in range(40)}
    logs[100] = [0.1, 0.1005, 0.101, 0.1015, 0.9]  # gains below the limit
    logs[101] = [i / 100 for i in range(300)]  # never stops
    rows = [(i, s, v) for i, log in logs.items() for s, v in enumerate(log)]
    rows += [(0, 1000 + s, None) for s in range(3)]  # training rows carry no score
    df = spark.createDataFrame(rows, "run_id long, step long, eval_bleu double").repartition(4)
    got = {r.run_id: r for r in runs.early_stop(df).collect()}
    assert set(got) == set(logs)
    for i, log in logs.items():
        r = got[i]
        assert (r.stopped_early, r.last_step, r.best_step, r.best_metric) == plain_stop(log)
        assert r.evaluations == r.last_step + 1


def test_report_record(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "bleu double, chrf double")
    splits = spark.createDataFrame([("train",), ("train",), ("test",)], "split string")
    row = runs.final_report(one, one, one, splits).first()
    assert row.dataset_sizes.asDict() == {"train": 2, "val": 0, "test": 1}
    assert row.test_metrics.chrf == 2.0
    lines = runs.comparison_rows(one).collect()
    assert sorted(tuple(r) for r in lines) == [("bleu", 1.0), ("chrf", 2.0)]


def plain_flatten(node, prefix=""):
    out = {}
    for k, v in node.items():
        path = f"{prefix}.{k}" if prefix else k
        out.update(plain_flatten(v, path) if isinstance(v, dict) else {path: v})
    return out


def test_flatten_deep_documents_in_one_query(spark):
    deep = "1"
    for i in range(50):
        deep = '{"k%d":%s,"v":"%d"}' % (i, deep, i)
    df = spark.createDataFrame([(7, deep)], "run_id long, config string")
    got = {r.path: r.value for r in tracking.flatten_config(df, "run_id", "config", "/").collect()}
    assert got == {"/".join(k): str(v) for k, v in leaves(json.loads(deep))}
    assert len(got) == 51


def leaves(node, path=()):
    for key, value in node.items():
        yield from leaves(value, (*path, key)) if isinstance(value, dict) else [((*path, key), value)]


def test_flatten(spark):
    configs = [
        {"a": 1, "b": {"c": "x", "d": {"e": True, "f": [1, {"g": 2}], "h": {}}}, "n": None},
        {},
        {"deep": {"deep": {"deep": {"deep": {"deep": 5}}}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(configs)], "run_id long, config string")
    got = {(r.run_id, r.path): r.value for r in tracking.flatten_config(df, "run_id", "config").collect()}
    want = {(i, p) for i, c in enumerate(configs) for p in plain_flatten(c)}
    assert set(got) == want
    assert got[(0, "b.c")] == "x" and got[(0, "a")] == "1" and got[(0, "n")] is None
    assert json.loads(got[(0, "b.d.f")]) == [1, {"g": 2}]
    assert got[(2, "deep.deep.deep.deep.deep")] == "5"


def test_metrics_and_tags(spark):
    log = spark.createDataFrame(
        [(1, "bleu", 0.1, 1, 1), (1, "bleu", 0.2, 2, 2), (1, "bleu", 0.15, 2, 3), (1, "loss", 9.0, 1, 4)],
        "run_id long, key string, value double, step long, ord long",
    )
    got = {r.key: r.value for r in tracking.latest_metrics(log).collect()}
    assert got == {"bleu": 0.15, "loss": 9.0}
    tags = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2"}), (None, {"c": "3"})], "x map<string,string>, y map<string,string>")
    merged = [r[0] for r in tags.select(tracking.merged_tags(F.col("x"), F.col("y"))).collect()]
    assert merged == [{"a": "1", "b": "2"}, {"c": "3"}]


def test_registry(spark):
    scored = spark.createDataFrame([("final", 0.5), ("final", 0.45)], "experiment string, test_bleu double")
    time = F.to_timestamp(F.lit("2024-05-06 07:08:09"))
    name = F.concat(F.lit("m"), F.col("test_bleu").cast("string"))
    models = tracking.register_model(scored, name, "models", time)
    ids = {r.id: r.path for r in models.collect()}
    assert ids["m0.5_20240506_070809"] == "models/final/m0.5_20240506_070809/model"
    requests = models.select(F.col("id").alias("model_id"), time.alias("promoted_at"))
    requests = requests.unionByName(
        spark.createDataFrame([("gone",)], "model_id string").withColumn("promoted_at", time)
    )
    promoted = tracking.promote_model(models, requests)
    assert [r.model_id for r in promoted.collect()] == ["m0.5_20240506_070809"]
    assert [r.model_id for r in tracking.unknown_models(models, requests).collect()] == ["gone"]
    with pytest.raises(ValueError):
        tracking.set_production(models, "gone")
    later = tracking.set_production(
        models, "m0.45_20240506_070809", F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    )
    current = tracking.current_production(promoted.unionByName(later)).first()
    assert current.model_id == "m0.45_20240506_070809"
    assert current.promoted_at == "2024-06-01T00:00:00.000000"


def test_failed_runs_never_win(spark):
    rows = [(1, 1, 0.9, 9.0, True, "FAIL"), (1, 2, 0.5, 5.0, False, "COMPLETE"), (1, 3, 0.7, 6.0, None, "PRUNED")]
    df = spark.createDataFrame(
        rows, "experiment long, ord long, test_bleu double, test_chrf double, failed boolean, state string"
    )
    assert runs.best_run(df, ("ord",), ("experiment",)).select("test_bleu").first()[0] == 0.7
    assert runs.best_overall(df, "test_bleu", "test_chrf").first().ord == 3
    assert [r.ord for r in runs.top_configs(df, 5).collect()] == [3, 2]
    assert [r.ord for r in runs.top_configs(df, 5, completed=True).collect()] == [2]
    assert runs.best_run(df.drop("failed"), ("test_chrf",)).first().test_bleu == 0.9
