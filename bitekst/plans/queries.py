"""The registered queries. Each one runs an operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitekst.functions import scores, sketches, text
from bitekst.operators import (
    alignment,
    assignment,
    cleaning,
    corpus,
    encoding,
    inference,
    runs,
    scoring,
    terminology,
    tracking,
)
from bitekst.plans import inputs
from bitekst.session import materialize, partitions_for, scratch_path, stored
from bitekst.sources import readers, writers
from bitekst.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits: sums of doubles depend on the order of the rows."""
    return df.select(*[r6(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- text cleaning -------------------------------------------------------------------------


@query
def clean_text(spark, sf):
    d = inputs.documents(spark, sf)
    return d.select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query
def word_count(spark, sf):
    d = inputs.documents(spark, sf)
    return d.select("doc_id", text.word_count(F.col("text")).alias("words"))


@query
def drop_dup_title(spark, sf):
    d = inputs.titled(spark, sf)
    return d.select("doc_id", cleaning.drop_dup_title(F.col("text")).alias("body"))


@query
def split_sentences(spark, sf):
    d = inputs.titled(spark, sf)
    s = cleaning.split_sentences(F.col("text"), "en")
    return d.select("doc_id", F.posexplode(s).alias("pos", "sentence")).withColumn(
        "pos", F.col("pos").cast("long")
    )


@query
def merge_short(spark, sf):
    return cleaning.sentences(inputs.titled(spark, sf), "doc_id", "text", "en", min_words=10)


@query
def strip_outputs(spark, sf):
    d = inputs.documents(spark, sf).select(
        F.col("doc_id").alias("pair_id"),
        F.concat(F.lit("  "), "text", F.lit("\n")).alias("prediction"),
        F.concat("text", F.lit("\t ")).alias("reference"),
    )
    return scoring.strip_outputs(d)


# --- corpus --------------------------------------------------------------------------------


@query
def filter_by_length(spark, sf):
    return corpus.filter_by_length(inputs.corpus(spark, sf)).select("pair_id", "source", "target")


@query
def preprocess_pairs(spark, sf):
    kept = corpus.preprocess_pairs(inputs.corpus(spark, sf), lowercase=True)
    return kept.select("pair_id", "source", "target")


@query
def subset(spark, sf):
    return corpus.subset(inputs.corpus(spark, sf), 300).select("pair_id", "source")


@query
def nested_subsets(spark, sf):
    return corpus.nested_subsets(inputs.corpus(spark, sf)).select("pair_id", "data_size")


@query
def create_splits(spark, sf):
    return corpus.create_splits(inputs.corpus(spark, sf)).select("pair_id", "split")


@query
def create_splits_approx(spark, sf):
    split = corpus.create_splits(inputs.corpus(spark, sf), exact=False)
    return split.select("pair_id", "split")


@query
def seed_grid(spark, sf):
    return corpus.seed_grid(inputs.corpus(spark, sf), 200).select("seed", "pair_id")


@query
def reverse_pairs(spark, sf):
    return corpus.reverse_pairs(inputs.corpus(spark, sf)).drop("metadata")


@query
def bidirectional(spark, sf):
    return corpus.bidirectional(inputs.corpus(spark, sf)).drop("metadata")


@query
def split_direction(spark, sf):
    forward, backward = corpus.split_direction(inputs.corpus(spark, sf))
    both = forward.withColumn("part", F.lit("forward")).unionByName(
        backward.withColumn("part", F.lit("reverse"))
    )
    return both.select("pair_id", "part", "src_lang", "tgt_lang")


@query
def mix_corpora(spark, sf):
    mixed = corpus.mix_corpora(
        {"documents": inputs.corpus(spark, sf), "turns": inputs.turns(spark, sf)}
    )
    return mixed.select("pair_id", "corpus", "source", "target")


@query
def preview(spark, sf):
    return corpus.preview(inputs.corpus(spark, sf), 5, 80)


@query
def corpus_stats(spark, sf):
    return rounded(corpus.corpus_stats(inputs.corpus(spark, sf)))


@query
def split_stats(spark, sf):
    return rounded(corpus.split_stats(corpus.create_splits(inputs.corpus(spark, sf))))


# --- alignment -----------------------------------------------------------------------------


def _aligned(spark, sf) -> tuple[DataFrame, DataFrame]:
    sentences = materialize(inputs.sentences(spark, sf))
    return sentences, alignment.align_documents(sentences)


@query
def doc_cosine(spark, sf):
    return rounded(alignment.doc_cosine(inputs.sentences(spark, sf)))


@query
def align_sequential(spark, sf):
    sequential, _ = alignment.split_branches(inputs.sentences(spark, sf))
    return rounded(alignment.align_sequential(sequential))


@query
def align_mutual_round(spark, sf):
    _, other = alignment.split_branches(inputs.sentences(spark, sf))
    return rounded(alignment.mutual_pairs(other))


@query
def align_one_to_one(spark, sf):
    _, other = alignment.split_branches(materialize(inputs.sentences(spark, sf)))
    return rounded(alignment.align_one_to_one(other))


@query
def align_documents(spark, sf):
    return rounded(_aligned(spark, sf)[1])


@query
def align_assignment(spark, sf):
    """The best assignment of documents whose sides differ in length."""
    _, other = alignment.split_branches(materialize(inputs.sentences(spark, sf)))
    return rounded(assignment.align_assignment(other))


@query
def align_documents_best(spark, sf):
    sentences = materialize(inputs.sentences(spark, sf))
    return rounded(alignment.align_documents(sentences, match=assignment.align_assignment))


@query
def assignment_totals(spark, sf):
    """What a document's best assignment is worth before the threshold, beside that of repeated
    mutual-best matching; vectors are cut to three numbers, so that many sentences look alike."""
    short = inputs.sentences(spark, sf).withColumn("v", F.slice("v", 1, 3))
    _, other = alignment.split_branches(materialize(short))
    best = assignment.best_in_tasks(other).groupBy("doc_id").agg(
        F.count("*").alias("pairs"), F.sum("similarity").alias("best_total")
    )
    mutual = alignment.align_one_to_one(other).groupBy("doc_id").agg(F.sum("similarity").alias("mutual_total"))
    total = F.coalesce("mutual_total", F.lit(0.0)).alias("mutual_total")
    return rounded(best.join(mutual, "doc_id", "left").select("doc_id", "pairs", "best_total", total))


@query
def align_long_documents(spark, sf):
    """Documents of five hundred sentences, more than one block of the similarity matrix."""
    return rounded(alignment.align_documents(materialize(inputs.sentences(spark, sf, 500))))


@query
def align_from_texts(spark, sf):
    """Split, merge, vectors, alignment; counts are those of the sentences before merging. Aligned texts
    are not asked for, so vectors alone go on."""
    split, merged = inputs.merged_sentences(spark, sf)
    merged = stored(merged.drop("sent"), "vectors")
    return rounded(alignment.align_doc_stats(split, alignment.align_documents(merged)))


@query
def align_doc_stats(spark, sf):
    return rounded(alignment.align_doc_stats(*_aligned(spark, sf)))


@query
def align_summary(spark, sf):
    return rounded(alignment.align_summary(alignment.align_doc_stats(*_aligned(spark, sf))))


@query
def clean_training_pairs(spark, sf):
    return alignment.clean_training_pairs(_aligned(spark, sf)[1])


def _progress(spark, sf, name: str) -> DataFrame:
    source, out, state = (scratch_path(spark, n) for n in ("sentences", "aligned", "progress"))
    parts = inputs.sentences(spark, sf).repartition(4, "doc_id")
    parts.write.parquet(source)
    progress.align_progressively(spark, source, out, state, files_per_batch=2)
    return rounded(progress.read_progress(spark, out, name).drop("batch_id"))


@query
def align_progressively(spark, sf):
    return _progress(spark, sf, "stats")


@query
def align_progress_pairs(spark, sf):
    return _progress(spark, sf, "pairs")


def _parts(spark, sf, name: str) -> DataFrame:
    """Every document in parts: its sentences are dealt over files of about equal size, and a third of the
    files is a batch."""
    source, out, state = (scratch_path(spark, n) for n in ("sentence-parts", "aligned-parts", "progress-parts"))
    sentences = materialize(inputs.sentences(spark, sf))
    sizes = sentences.groupBy("doc_id").agg(F.count("*").alias("total"))
    files = -(-partitions_for(sentences) // 3)
    sentences.join(sizes, "doc_id").repartition(3 * files, "side", "pos", "doc_id").write.parquet(source)
    progress.align_progressively(spark, source, out, state, files_per_batch=files, end="total")
    return rounded(progress.read_progress(spark, out, name).drop("batch_id"))


@query
def align_document_parts(spark, sf):
    return _parts(spark, sf, "pairs")


@query
def align_document_parts_stats(spark, sf):
    return _parts(spark, sf, "stats")


# --- terminology ---------------------------------------------------------------------------


@query
def glossary_load(spark, sf):
    return inputs.glossary(spark, sf)


@query
def glossary_inverse(spark, sf):
    return terminology.glossary_inverse(inputs.glossary(spark, sf))


@query
def extract_terms(spark, sf):
    found = terminology.extract_terms(inputs.pairs(spark, sf), inputs.glossary(spark, sf))
    return found.select("pair_id", "term")


@query
def mark_terms(spark, sf):
    p = inputs.pairs(spark, sf).select("pair_id", "source")
    return terminology.mark_terms(p, inputs.glossary(spark, sf))


@query
def mark_pairs(spark, sf):
    marked = terminology.mark_pairs(
        inputs.corpus(spark, sf).withColumn("source", text.clean(F.col("source"))),
        inputs.glossary(spark, sf),
    )
    noted = F.col("metadata")["terminology_marked"].alias("marked")
    return marked.select("pair_id", "source", "target", noted)


@query
def term_stats(spark, sf):
    return rounded(
        terminology.term_stats(inputs.pairs(spark, sf), inputs.glossary(spark, sf))
    )


def _term_check(spark, sf, fuzzy: bool) -> DataFrame:
    p, g = inputs.pairs(spark, sf), inputs.glossary(spark, sf)
    expected = terminology.expected_terms(p, g)
    return terminology.term_in_prediction(p, expected, g, fuzzy=fuzzy)


@query
def term_in_prediction(spark, sf):
    return _term_check(spark, sf, fuzzy=False)


@query
def term_in_prediction_fuzzy(spark, sf):
    return _term_check(spark, sf, fuzzy=True)


@query
def fuzzy_windows(spark, sf):
    p, g = inputs.pairs(spark, sf), inputs.glossary(spark, sf)
    return terminology.fuzzy_windows(p, terminology.expected_terms(p, g), g)


def _accuracy_rows(spark, sf, fuzzy: bool) -> DataFrame:
    p, g = inputs.pairs(spark, sf), inputs.glossary(spark, sf)
    return terminology.term_accuracy_rows(p, g, fuzzy=fuzzy)


@query
def term_accuracy_rows(spark, sf):
    return rounded(_accuracy_rows(spark, sf, fuzzy=False))


@query
def term_accuracy_rows_fuzzy(spark, sf):
    return rounded(_accuracy_rows(spark, sf, fuzzy=True))


@query
def term_accuracy(spark, sf):
    return rounded(terminology.term_accuracy(_accuracy_rows(spark, sf, fuzzy=False)))


@query
def term_accuracy_fuzzy(spark, sf):
    return rounded(terminology.term_accuracy(_accuracy_rows(spark, sf, fuzzy=True)))


@query
def evaluate_with_terms(spark, sf):
    p, g = inputs.pairs(spark, sf), inputs.glossary(spark, sf)
    return rounded(terminology.evaluate_with_terms(p, g, fuzzy=False))


@query
def evaluate_with_terms_fuzzy(spark, sf):
    p, g = inputs.pairs(spark, sf), inputs.glossary(spark, sf)
    return rounded(terminology.evaluate_with_terms(p, g))


# --- scoring -------------------------------------------------------------------------------


@query
def tok13a(spark, sf):
    d = inputs.documents(spark, sf)
    return d.select("doc_id", F.array_join(scores.tokens(F.col("text")), " ").alias("tokens"))


@query
def bleu_rows(spark, sf):
    return scoring.ngram_matches(inputs.pairs(spark, sf))


@query
def bleu_sentence(spark, sf):
    return rounded(scoring.bleu_sentence(inputs.pairs(spark, sf)))


@query
def bleu_corpus(spark, sf):
    return rounded(scoring.bleu_corpus(inputs.pairs(spark, sf), by=("lang",)))


@query
def chrf_sentence(spark, sf):
    return rounded(scoring.chrf_sentence(inputs.pairs(spark, sf)))


@query
def chrf_corpus(spark, sf):
    return rounded(scoring.chrf_corpus(inputs.pairs(spark, sf), by=("lang",)))


@query
def classify_error(spark, sf):
    return scoring.classify_error(inputs.pairs(spark, sf))


@query
def error_samples(spark, sf):
    return rounded(scoring.error_samples(inputs.pairs(spark, sf)))


@query
def error_class_counts(spark, sf):
    samples = scoring.error_samples(inputs.pairs(spark, sf))
    return rounded(scoring.error_class_counts(samples))


@query
def score_distribution(spark, sf):
    return rounded(scoring.score_distribution(scoring.bleu_sentence(inputs.pairs(spark, sf))))


@query
def score_sketches(spark, sf):
    """Distribution by language from stored sketches of four batches, and whether the rank of every
    quartile lies within the stated error, held against all scores."""
    scored = scoring.bleu_sentence(inputs.pairs(spark, sf), keep=("lang",))
    batch = F.pmod("pair_id", F.lit(4)).alias("batch")
    rows = materialize(scored.select("lang", batch, "bleu"))
    stored = materialize(sketches.score_sketches(rows, ["lang", "batch"], "bleu"))
    found = sketches.distribution(sketches.merge_sketches(stored, ["lang"]))
    f, r = found.alias("f"), rows.alias("r")
    met = r.join(f, F.col("r.lang").eqNullSafe(F.col("f.lang")))
    checks = []
    for name, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        below, upto = F.avg((F.col("bleu") < F.col(name)).cast("int")), F.avg((F.col("bleu") <= F.col(name)).cast("int"))
        checks.append(((below <= p + sketches.RANK_ERROR) & (upto >= p - sketches.RANK_ERROR)).alias(f"{name}_within"))
    kept = ["rows", "mean", "std", "min", "max"]
    return rounded(met.groupBy("f.lang", *kept).agg(*checks).select("lang", *kept, "q25_within", "median_within", "q75_within"))


@query
def score_summary(spark, sf):
    scored = inputs.table(spark, sf, "events").withColumn("score", F.col("value") / 100)
    return rounded(scoring.score_summary(scored, by=("event_type",)))


@query
def evaluate_all(spark, sf):
    chars = F.char_length("prediction") / F.greatest(F.char_length("reference"), F.lit(1))
    p = inputs.pairs(spark, sf).withColumn("score", chars)
    return rounded(scoring.evaluate_all(p, by=("lang",), score="score"))


@query
def predictions(spark, sf):
    p = inputs.pairs(spark, sf)
    return scoring.prediction_table(
        p.select("pair_id", "source"), p.select("pair_id", "prediction", "reference")
    )


def _word_reverser():
    return lambda texts: [" ".join(reversed(t.split(" "))) for t in texts]


@query
def predict_batches(spark, sf):
    return inference.predict_batches(inputs.pairs(spark, sf), _word_reverser)


def _encoded(spark, sf) -> DataFrame:
    vocabulary = materialize(inputs.vocabulary(spark, sf))
    return encoding.encode_pairs(inputs.corpus(spark, sf), vocabulary)


def _joined_ids(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.array_join(c, " ").alias(c) if t.startswith("array") else F.col(c)
            for c, t in df.dtypes
        ]
    )


@query
def encode_pairs(spark, sf):
    return _joined_ids(_encoded(spark, sf))


@query
def pad_batches(spark, sf):
    return _joined_ids(encoding.pad_batches(_encoded(spark, sf), 8))


# --- runs ----------------------------------------------------------------------------------


@query
def param_grid(spark, sf):
    """The grid with the mean score of the runs that used each combination."""
    scored = (
        inputs.runs(spark, sf)
        .groupBy("r", "alpha", F.round("dropout", 2).alias("dropout"))
        .agg(F.count("*").alias("runs"), F.avg("test_bleu").alias("test_bleu"))
    )
    grid = runs.param_grid(spark, dropout=(0.0, 0.05, 0.1))
    joined = grid.join(scored, ["r", "alpha", "dropout"], "left")
    return rounded(joined.withColumn("runs", F.coalesce("runs", F.lit(0))))


@query
def runs_with_status(spark, sf):
    fixed = runs.runs_with_status(
        inputs.runs(spark, sf), ("test_bleu", "test_chrf"), ("val_loss",)
    )
    return rounded(
        fixed.select("experiment", "ord", "test_bleu", "test_chrf", "val_loss", "failed")
    )


@query
def learning_curve(spark, sf):
    return rounded(runs.learning_curve(inputs.runs(spark, sf), ("experiment",)))


@query
def best_run(spark, sf):
    found = runs.best_run(
        inputs.runs(spark, sf), ("r", "alpha", "dropout", "data_size"), ("experiment",)
    )
    return rounded(found)


@query
def top_configs(spark, sf):
    top = runs.top_configs(inputs.runs(spark, sf), 5, ("experiment",))
    return rounded(top.select("experiment", "rank", "ord", "r", "alpha", "dropout", "test_bleu"))


@query
def top_completed(spark, sf):
    top = runs.top_configs(inputs.runs(spark, sf), 5, ("experiment",), completed=True)
    return rounded(top.select("experiment", "rank", "ord", "r", "alpha", "dropout", "test_bleu"))


@query
def top_configs_overall(spark, sf):
    top = runs.top_configs(inputs.runs(spark, sf))
    return rounded(top.select("ord", "r", "alpha", "dropout", "test_bleu"))


@query
def score_heatmap(spark, sf):
    return rounded(runs.score_heatmap(inputs.runs(spark, sf), ("experiment",)))


@query
def config_summary(spark, sf):
    return runs.config_summary(inputs.runs(spark, sf), by=("experiment",))


@query
def trial_summary(spark, sf):
    return rounded(runs.trial_summary(inputs.runs(spark, sf), ("experiment",)))


@query
def pareto_front(spark, sf):
    valid = inputs.runs(spark, sf).filter("not failed")
    return rounded(runs.pareto_front(valid, "test_bleu", "test_chrf", ("experiment",)))


@query
def pareto_front_overall(spark, sf):
    valid = inputs.runs(spark, sf).filter("not failed")
    return rounded(runs.pareto_front(valid, "test_bleu", "test_chrf"))


@query
def best_overall(spark, sf):
    found = runs.best_overall(inputs.runs(spark, sf), "test_bleu", "test_chrf", ("experiment",))
    return rounded(found)


@query
def comparison_rows(spark, sf):
    report = scoring.evaluate_all(inputs.pairs(spark, sf), by=("lang",))
    return rounded(runs.comparison_rows(report, ("lang",)))


@query
def choose_config(spark, sf):
    every = inputs.runs(spark, sf)
    columns = ("r", "alpha", "dropout")
    stage2 = runs.best_run(every.filter("stage = 'O'"), columns)
    grid = runs.best_run(every.filter("stage = 'F'"), columns)
    return rounded(runs.choose_config(stage2, grid))


@query
def recommended_subset(spark, sf):
    best = runs.best_run(inputs.runs(spark, sf), ("data_size",))
    size = runs.recommended_size(best)
    return corpus.subset(inputs.corpus(spark, sf), size).select("pair_id", "source")


@query
def validation_runs(spark, sf):
    top = runs.top_configs(inputs.runs(spark, sf), 5, ("experiment",))
    repeated = runs.validation_runs(top.select("experiment", "rank", "r", "alpha", "dropout"))
    return rounded(repeated)


@query
def early_stop(spark, sf):
    evals = inputs.eval_log(spark, sf)
    return rounded(runs.early_stop(evals, metric="value", patience=3, min_gain=0.5))


@query
def final_report(spark, sf):
    # Two questions to the runs, which take a sort of the whole table: worked out once.
    columns = ("r", "alpha", "dropout", "ord", "failed", "test_bleu", "test_chrf", "val_loss")
    every = materialize(inputs.runs(spark, sf).select(*columns))
    config = runs.best_run(every, ("r", "alpha", "dropout")).select("r", "alpha", "dropout")
    val = every.filter("not failed").agg(
        F.avg("test_bleu").alias("bleu"), F.avg("test_chrf").alias("chrf"),
        F.avg("val_loss").alias("loss"),
    )
    test = scoring.evaluate_all(inputs.pairs(spark, sf))
    splits = corpus.create_splits(inputs.corpus(spark, sf))
    report = runs.final_report(config, val, test, splits)
    return rounded(
        report.select(
            F.col("configuration.r").alias("r"),
            F.col("configuration.alpha").alias("alpha"),
            F.col("configuration.dropout").alias("dropout"),
            F.col("validation_metrics.bleu").alias("val_bleu"),
            F.col("validation_metrics.chrf").alias("val_chrf"),
            F.col("validation_metrics.loss").alias("val_loss"),
            F.col("test_metrics.bleu").alias("test_bleu"),
            F.col("test_metrics.chrf").alias("test_chrf"),
            F.col("dataset_sizes.train").alias("train"),
            F.col("dataset_sizes.val").alias("val"),
            F.col("dataset_sizes.test").alias("test"),
        )
    )


# --- tracking and registry -----------------------------------------------------------------


@query
def flatten_config(spark, sf):
    return tracking.flatten_config(inputs.run_configs(spark, sf), "run_id", "config")


@query
def metric_log(spark, sf):
    return rounded(tracking.latest_metrics(inputs.eval_log(spark, sf)))


@query
def merged_tags(spark, sf):
    e = inputs.table(spark, sf, "events")
    shared = F.create_map(F.lit("team"), F.lit("mt"), F.lit("kind"), F.lit("default"))
    own = F.create_map(F.lit("kind"), F.col("event_type"))
    merged = e.select("event_id", tracking.merged_tags(shared, own).alias("t"))
    return merged.select(
        "event_id",
        F.col("t")["team"].alias("team"),
        F.col("t")["kind"].alias("kind"),
        F.size("t").cast("long").alias("tags"),
    )


@query
def log_experiment(spark, sf):
    params = tracking.flatten_config(inputs.run_configs(spark, sf), "run_id", "config")
    log = inputs.eval_log(spark, sf)
    metrics = log.select(
        F.col("step").alias("run_id"), "key", F.round(F.col("value") * 100).cast("long").alias("value")
    )
    artifacts = log.select(
        F.col("step").alias("run_id"), F.lit("report").alias("name"),
        F.concat(F.lit("reports/"), "key").alias("path"),
    )
    return tracking.log_experiment(params, metrics, artifacts)


def _models(spark, sf) -> DataFrame:
    events = inputs.table(spark, sf, "events")
    scored = events.select(
        "event_id", F.col("event_type").alias("experiment"), "ts",
        (F.col("value") / 100).alias("test_bleu"),
    )
    name = F.concat(F.lit("model-"), F.col("event_id").cast("string"))
    note = F.concat(F.lit("event of "), F.col("experiment"))
    return tracking.register_model(
        scored, name, "models/experiments", F.col("ts"), metrics=("test_bleu",),
        config=("event_id", "experiment"), description=note,
    )


@query
def register_model(spark, sf):
    """Registered in two steps, the second of which brings all models again."""
    path, models = scratch_path(spark, "registry"), _models(spark, sf)
    tracking.append_models(models.filter("event_id % 2 = 0"), path)
    tracking.append_models(models, path)
    return tracking.read_models(spark, path).select(
        "id", "name", "experiment", "timestamp", "description", "path",
        F.col("metrics")["test_bleu"].isNotNull().alias("has_bleu"),
        F.col("config")["event_id"].cast("long").alias("event_id"),
    )


@query
def promote_model(spark, sf):
    models = _models(spark, sf)
    requests = models.select(F.col("id").alias("model_id"), F.col("ts").alias("promoted_at"))
    return tracking.promote_model(models, requests, above=0.45).drop("promoted_at")


@query
def current_production(spark, sf):
    models = _models(spark, sf)
    requests = models.select(F.col("id").alias("model_id"), F.col("ts").alias("promoted_at"))
    promoted = tracking.promote_model(models, requests, above=0.45)
    return tracking.current_production(promoted).drop("promoted_at")


# --- sources and sinks ---------------------------------------------------------------------


@query
def run_log_rows(spark, sf):
    states = inputs.run_states(spark, sf)
    return rounded(readers.run_log_rows(states, "run_id"))


@query
def read_run_logs(spark, sf):
    """The states of the runs written as files, a folder per group of runs."""
    path = scratch_path(spark, "states")
    states = inputs.run_states(spark, sf)
    named = F.transform(
        "log_history",
        lambda e: F.struct(
            e["step"].alias("step"), e["loss"].alias("loss"), e["eval_bleu"].alias("eval_bleu"),
            F.col("run_id").cast("double").alias("epoch"),
        ),
    )
    out = states.select(F.floor(F.col("run_id") / 50).alias("part"), named.alias("log_history"))
    out.write.partitionBy("part").json(path)
    rows = readers.read_run_logs(spark, path + "/part=*", lines=True)
    part = F.regexp_extract("run_id", r"/part=(\d+)/", 1).cast("long")
    return rounded(rows.select(part.alias("part"), "epoch", "step", "loss", "eval_bleu"))


@query
def read_state_files(spark, sf):
    """Whole state files, an object over several lines each, with more in it than the log."""
    path = scratch_path(spark, "state_files")
    entry = lambda e: F.struct(
        e["step"].alias("step"), e["loss"].alias("loss"), e["eval_bleu"].alias("eval_bleu")
    )
    state = F.to_json(
        F.struct(
            F.lit(None).cast("string").alias("best_metric"),
            F.lit(False).alias("is_hyper_param_search"),
            F.transform("log_history", entry).alias("log_history"),
            F.struct(F.lit(500).alias("save_steps")).alias("args"),
        ),
        {"pretty": "true", "ignoreNullFields": "false"},
    )
    # A folder per state; files cost time each, so all cores write them, and tasks list the folders.
    folder = F.concat_ws("-", "run_id", F.monotonically_increasing_id()).alias("run")
    states = inputs.run_states(spark, sf).select(state.alias("value"), folder)
    states.repartition(4 * spark.sparkContext.defaultParallelism).write.partitionBy("run").text(path)
    rows = readers.read_run_logs(spark, path)
    run = F.regexp_extract("run_id", r"/run=(\d+)-\d+/", 1).cast("long")
    return rounded(rows.select(run.alias("run_id"), "step", "loss", "eval_bleu"))


def _memory(spark, sf) -> DataFrame:
    """Documents written as translation units, one empty and one regional variant each, and read
    again."""
    path = scratch_path(spark, "tmx")
    c = inputs.corpus(spark, sf)

    def variant(lang: str, content: Column) -> Column:
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            content = F.replace(content, F.lit(char), F.lit(entity))
        return F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), content, F.lit("</seg></tuv>"))

    flat = text.clean(F.regexp_replace("source", r"\p{Cc}", " "))
    unit = F.concat(
        F.lit("<tu>"),
        variant("en-US", F.lit("regional")),
        variant("nb", F.concat(F.lit(" "), flat, F.lit(" "))),
        variant("en", F.lit("first")),
        variant("en", F.concat(F.col("pair_id").cast("string"), F.lit(" & more"))),
        variant("en", F.lit("")),
        F.lit("</tu>"),
    )
    # One well-formed file per hundred units.
    units = F.array_sort(F.collect_list(F.struct("pair_id", unit.alias("unit"))))
    body = F.array_join(F.transform(units, lambda u: u["unit"]), "")
    number = F.format_string("%012d", F.floor(F.col("pair_id") / 100))
    files = c.groupBy(number.alias("file")).agg(
        F.concat(F.lit("<tmx><body>"), body, F.lit("</body></tmx>")).alias("value")
    )
    files.write.partitionBy("file").text(path)
    return readers.read_tmx(spark, path)


@query
def read_tmx(spark, sf):
    return _memory(spark, sf)


@query
def convert_tmx(spark, sf):
    """A translation memory in every output format, read back as (format, source, target)."""
    memory = _memory(spark, sf)
    path = scratch_path(spark, "converted")
    for name in ("tsv", "jsonl", "huggingface"):
        writers.export_pairs(memory, f"{path}/{name}", name)
    tsv = spark.read.options(sep="\t", header=True, quote='"', escape='"', multiLine=True)
    tsv = tsv.schema("source string, target string").csv(f"{path}/tsv")
    jsonl = spark.read.schema("source string, target string").json(f"{path}/jsonl")
    nested = spark.read.schema("translation struct<nb: string, en: string>").json(f"{path}/huggingface")
    nested = nested.select(F.col("translation.nb").alias("source"), F.col("translation.en").alias("target"))
    out = None
    for name, df in (("tsv", tsv), ("jsonl", jsonl), ("huggingface", nested)):
        part = df.select(F.lit(name).alias("format"), "source", "target")
        out = part if out is None else out.unionByName(part)
    return out


@query
def write_fairseq(spark, sf):
    """A translation memory as line-aligned files; lines of both sides are put together again by
    their place."""
    prefix = scratch_path(spark, "fairseq")
    writers.export_pairs(_memory(spark, sf), prefix, "fairseq")
    return _side_by_side(spark, prefix)


def _side_by_side(spark, prefix: str) -> DataFrame:
    place = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")

    def side(name: str) -> DataFrame:
        lines = spark.read.text(f"{prefix}.{name}", wholetext=True)
        # the last line ends with a break as well
        rows = lines.select(place.alias("file"), F.split(F.rtrim("value", F.lit("\n")), "\n").alias("l"))
        return rows.select("file", F.posexplode("l").alias("line", name))

    return side("no").join(side("en"), ["file", "line"]).select("no", "en")


@query
def read_pairs_json(spark, sf):
    path = scratch_path(spark, "pairs")
    c = inputs.corpus(spark, sf)
    absent = F.when(F.col("metadata").isNotNull(), F.col("target")).alias("target")
    c.orderBy("pair_id").select("source", absent, "metadata").write.json(path)
    read = readers.read_pairs_json(spark, path, lines=True)
    return read.select(
        "pair_id", "source", "target", F.coalesce(F.col("metadata")["direction"], F.lit("")).alias("direction")
    )


@query
def read_document_pairs(spark, sf):
    path = scratch_path(spark, "docs")
    inputs.corpus(spark, sf).orderBy("pair_id").select("source", "target").write.json(path)
    return readers.read_document_pairs(spark, path, lines=True)


def _as_array(lines: DataFrame, path: str, of: int) -> None:
    """Rows (ord, json) as files that hold one JSON array each, over several lines, of ``of`` rows."""
    file = F.floor(F.col("ord") / of).alias("file")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "json"))), lambda x: x["json"])
    array = F.concat(F.lit("[\n  "), F.array_join(ordered, ",\n  "), F.lit("\n]"))
    files = lines.groupBy(file).agg(array.alias("value"))
    files.select("value", F.format_string("%08d", "file").alias("part")).write.partitionBy("part").text(path)


@query
def read_pairs_array(spark, sf):
    """Pairs from JSON arrays of a hundred, the form in which corpora come."""
    path = scratch_path(spark, "arrays")
    c = inputs.corpus(spark, sf)
    absent = F.when(F.col("metadata").isNotNull(), F.col("target")).alias("target")
    _as_array(c.select(F.col("pair_id").alias("ord"), F.to_json(F.struct("source", absent, "metadata")).alias("json")), path, 100)
    read = readers.read_pairs_json(spark, path + "/*/*.txt")
    return read.select(
        "pair_id", "source", "target", F.coalesce(F.col("metadata")["direction"], F.lit("")).alias("direction")
    )


@query
def read_document_array(spark, sf):
    path = scratch_path(spark, "arrays")
    c = inputs.corpus(spark, sf)
    _as_array(c.select(F.col("pair_id").alias("ord"), F.to_json(F.struct("source", "target")).alias("json")), path, 100)
    return readers.read_document_pairs(spark, path + "/*/*.txt")


@query
def read_glossary(spark, sf):
    path = scratch_path(spark, "glossary")
    entries = inputs.glossary_entries(spark, sf)
    entries.orderBy("ord").select("en", "no").write.json(path)
    loaded = terminology.glossary_load(readers.read_glossary(spark, path, lines=True))
    return loaded.select("src_term", "tgt_term")


@query
def write_parallel(spark, sf):
    prefix = scratch_path(spark, "parallel")
    writers.export_pairs(inputs.corpus(spark, sf), prefix, "parallel")
    sides = [
        spark.read.text(f"{prefix}.{s}").select(F.lit(s).alias("side"), F.col("value").alias("line"))
        for s in ("no", "en")
    ]
    return sides[0].unionByName(sides[1])


@query
def write_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    writers.export_pairs(inputs.corpus(spark, sf), path, "tsv")
    spacing = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    return (
        spark.read.options(sep="\t", header=True, quote='"', escape='"', multiLine=True, **spacing)
        .schema("norwegian string, english string")
        .csv(path)
        .select(F.coalesce("norwegian", F.lit("")).alias("norwegian"),
                F.coalesce("english", F.lit("")).alias("english"))
    )


@query
def write_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    writers.export_pairs(inputs.corpus(spark, sf), path, "jsonl")
    schema = "source string, target string, source_lang string, target_lang string"
    return spark.read.schema(schema).json(path)


@query
def write_nested(spark, sf):
    path = scratch_path(spark, "nested")
    writers.export_pairs(inputs.corpus(spark, sf), path, "huggingface")
    read = spark.read.schema("translation struct<nb: string, en: string>").json(path)
    return read.select("translation.nb", "translation.en")


@query
def load_splits(spark, sf):
    path = scratch_path(spark, "splits")
    writers.write_splits(corpus.create_splits(inputs.corpus(spark, sf)), path)
    parts = readers.load_splits(spark, path, use_subset=100)
    both = parts["train"].unionByName(parts["val"]).unionByName(parts["test"])
    return both.select("pair_id", "split")


@query
def write_results(spark, sf):
    path = scratch_path(spark, "results")
    summary = runs.config_summary(inputs.runs(spark, sf), by=("experiment",))
    writers.write_results(summary, path)
    schema = summary.schema
    return spark.read.schema(schema).option("header", True).csv(f"{path}.csv")
