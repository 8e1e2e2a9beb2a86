"""Inputs of the registered queries, derived from the given tables.

The tables hold no translations, system outputs or experiment runs, so these are derived: whole
tables and whole texts go in, nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitekst.functions.text import clean, words
from bitekst.operators import cleaning
from bitekst.operators.terminology import glossary_load
from bitekst.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a file over the cores if fewer of its splits than cores hold any, so that work
    on texts does not wait for a few tasks. Only splits are looked at, no columns are read for that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = df.select(F.spark_partition_id()).distinct().count()
    return df if held >= cores else df.repartition(4 * cores)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): English documents get their first line once more, as a title."""
    docs = spread(documents(spark, sf_dir))
    first = F.get(F.split("text", "\n"), F.lit(0))
    repeated = F.concat(first, F.lit("\n"), F.col("text"))
    return docs.select(
        "doc_id", F.when(F.col("lang") == "en", repeated).otherwise(F.col("text")).alias("text")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, lang, source, prediction, reference): a noisy system output for each document.

    The output drops about every eleventh word; some documents are thinned to a third, doubled, or
    reversed, so that every error class occurs.
    """
    base = spread(documents(spark, sf_dir)).select("doc_id", "lang", words(F.col("text")).alias("w"))
    i_drop = F.filter("w", lambda _, i: (i * 7 + F.col("doc_id")) % 11 != 0)
    output = (
        F.when(F.col("doc_id") % 13 == 0, F.filter("w", lambda _, i: i % 3 == 0))
        .when(F.col("doc_id") % 17 == 0, F.concat("w", "w"))
        .when(F.col("doc_id") % 19 == 0, F.reverse("w"))
        .otherwise(i_drop)
    )
    return base.select(
        F.col("doc_id").alias("pair_id"),
        "lang",
        F.array_join("w", " ").alias("source"),
        F.array_join(output, " ").alias("prediction"),
        F.array_join("w", " ").alias("reference"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, source, target, metadata): each document with its words in reverse order."""
    reverse = F.create_map(F.lit("direction"), F.lit("reverse"))
    forward = F.create_map(F.lit("lang"), F.col("lang"))
    return spread(documents(spark, sf_dir)).select(
        F.col("doc_id").alias("pair_id"),
        F.col("text").alias("source"),
        F.array_join(F.reverse(words(F.col("text"))), " ").alias("target"),
        F.when(F.col("lang") == "de", reverse)
        .when(F.col("lang") != "es", forward)
        .alias("metadata"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, source, target, metadata): each conversation turn with the one that follows."""
    t = table(spark, sf_dir, "conversations")
    following = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return t.join(following, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
        F.col("text").alias("source"),
        "target",
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def glossary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, en, no): two entries from every six words of each benchmark text, with stray spaces and
    capitals."""
    w = table(spark, sf_dir, "benchmark").select(
        "item_id",
        F.filter(F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " "), lambda x: x != "").alias(
            "w"
        ),
    )
    six = F.sequence(F.lit(0), F.greatest(F.floor((F.size("w") - 1) / 6), F.lit(0)))
    w = w.select("item_id", "w", F.explode(six).alias("k"))
    at = lambda i: F.get("w", (F.col("k") * 6 + i).cast("int"))
    ord_ = (F.col("item_id") * 1000 + F.col("k")) * 2
    two = F.array(
        F.struct(
            ord_.alias("ord"),
            F.concat(F.lit(" "), at(0), F.lit(" "), at(1)).alias("en"),
            F.concat(at(2), F.lit(" "), at(3)).alias("no"),
        ),
        F.struct((ord_ + 1).alias("ord"), at(4).alias("en"), at(5).alias("no")),
    )
    return w.select(F.inline(two))


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary_load(glossary_entries(spark, sf_dir), order="ord")


def sentences(spark: SparkSession, sf_dir: str, per_doc: int = 10) -> DataFrame:
    """(doc_id, side, pos, sent, v): ``per_doc`` supplied vectors make a document.

    The other side has slightly shifted vectors, and one sentence for each run of neighbours with
    the same label, so that many documents differ in their sentence counts.
    """
    texts = documents(spark, sf_dir).select(
        F.col("doc_id").alias("vec_id"), clean(F.col("text")).alias("sent")
    )
    base = (
        table(spark, sf_dir, "embeddings")
        .join(texts, "vec_id", "left")
        .select(
            F.floor(F.col("vec_id") / per_doc).cast("long").alias("doc_id"),
            "vec_id",
            "label",
            F.coalesce("sent", F.concat(F.lit("vector "), F.col("vec_id").cast("string"))).alias("sent"),
            F.col("embedding").cast("array<double>").alias("v"),
        )
    )
    in_doc = Window.partitionBy("doc_id").orderBy("vec_id")
    previous = F.lag("label").over(in_doc)
    numbered = base.withColumn("new", F.when(F.col("label") == previous, 0).otherwise(1))
    numbered = numbered.withColumns(
        {
            "en_pos": F.row_number().over(in_doc).cast("long") - 1,
            "no_pos": F.sum("new").over(in_doc) - 1,
        }
    )
    shifted = F.transform(
        "v", lambda x, i: x + F.lit(0.02) * ((i * 7 + F.col("vec_id")) % 5 - 2)
    )
    english = numbered.select("doc_id", F.lit("en").alias("side"), F.col("en_pos").alias("pos"), "sent", "v")
    other = numbered.filter("new = 1").select(
        "doc_id",
        F.lit("no").alias("side"),
        F.col("no_pos").alias("pos"),
        F.concat(F.lit("no: "), "sent").alias("sent"),
        shifted.alias("v"),
    )
    return english.unionByName(other)


def merged_sentences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sentences of documents and of a copy that lacks the last one of every second document: as
    they are split (doc_id, side, pos), and merged with vectors (doc_id, side, pos, sent, v).

    Vectors count letters, for want of a model. Texts are split once, as what is left of a document is
    stored: its number of sentences and the merged ones.
    """
    d = titled(spark, sf_dir).select("doc_id", cleaning.split_sentences(F.col("text"), "en").alias("s"))
    d = stored(d.select("doc_id", F.size("s").alias("n"), cleaning.merge_short(F.col("s"), 10).alias("m")), "merged")

    def fewer(size: Column) -> Column:
        return F.greatest(size - F.col("doc_id") % 2, F.lit(0)).cast("int")

    def letters(t: Column) -> Column:
        count = [F.octet_length(t) - F.octet_length(F.replace(t, F.lit(c), F.lit(""))) + 1 for c in "aeiounrs"]
        return F.array(*[c.cast("double") for c in count])

    # the letters of a sentence without the mark of its side: counted once for both, unless it begins with one itself
    rows = d.select("doc_id", fewer(F.size("m")).alias("fewer"), F.posexplode("m").alias("pos", "t"))
    rows = rows.withColumns({"v": letters(F.regexp_replace("t", "^no: ", "")), "pos": F.col("pos").cast("long")})
    marked = F.when(F.startswith("t", F.lit("no: ")), letters(F.col("t"))).otherwise(F.col("v"))
    both = F.array(
        F.struct(F.lit("en").alias("side"), F.col("t").alias("sent"), "v"),
        F.struct(F.lit("no").alias("side"), F.concat(F.lit("no: "), "t").alias("sent"), marked.alias("v")),
    )
    merged = rows.select("doc_id", "fewer", "pos", F.inline(both)).filter("side = 'en' or pos < fewer")
    merged = merged.select("doc_id", "side", "pos", "sent", "v")
    sizes = F.array(
        F.struct(F.lit("en").alias("side"), F.col("n").alias("size")),
        F.struct(F.lit("no").alias("side"), fewer(F.col("n")).alias("size")),
    )
    split = d.select("doc_id", F.inline(sizes)).filter("size > 0")
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - F.lit(1).cast("long")))
    return split.select("doc_id", "side", places.alias("pos")), merged


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment runs, one per order line; a supplier is an experiment.

    Order and line number repeat in the table, so equal ones are merged to the highest values. They
    seldom do, and a maximum of texts takes a sort, so rows are dealt first and sorted once.
    """
    keys = ["l_orderkey", "l_linenumber"]
    line = table(spark, sf_dir, "lineitem")
    line = line.repartition(*keys).groupBy(*keys).agg(*[F.max(c).alias(c) for c in line.columns if c not in keys])
    pick = "case {} % 3 when 0 then {} when 1 then {} else {} end"
    return line.select(
        F.col("l_suppkey").alias("experiment"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        (F.col("l_partkey") % 100).alias("config_id"),
        F.expr(f"cast({pick.format('l_linenumber', 8, 16, 32)} as int)").alias("r"),
        F.expr(f"cast({pick.format('l_quantity', 16, 32, 64)} as int)").alias("alpha"),
        F.col("l_discount").alias("dropout"),
        F.col("l_linenumber").alias("run"),
        (F.col("l_partkey") % 500 + 100).alias("data_size"),
        (F.col("l_extendedprice") / F.lit(209000.0)).alias("test_bleu"),
        (F.col("l_quantity") * 2).alias("test_chrf"),
        (F.lit(1) - F.col("l_tax")).alias("val_loss"),
        (F.col("l_returnflag") == "R").alias("failed"),
        F.when(F.col("l_returnflag") == "R", "FAIL")
        .when(F.col("l_linestatus") == "F", "PRUNED")
        .otherwise("COMPLETE")
        .alias("state"),
        F.col("l_linestatus").alias("stage"),
    )


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, key, value, step, ord): events as logged metrics, a user is a run."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("key"),
        "value",
        F.col("event_id").alias("step"),
        F.col("event_id").alias("ord"),
    )


def run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, config): a nested JSON configuration per event."""
    e = table(spark, sf_dir, "events")
    config = F.format_string(
        '{"run":{"id":%d,"kind":"%s","extra":{"props":%s,"none":{}}},"user":%d,"tags":["a",%d]}',
        "event_id",
        "event_type",
        "props",
        "user_id",
        "user_id",
    )
    return e.select(F.col("event_id").alias("run_id"), config.alias("config"))


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, log_history): a conversation as a training run; answers are evaluations.

    A state holds at most a hundred entries, so a long run has several.
    """
    t = table(spark, sf_dir, "conversations")
    size = F.char_length("text").cast("double")
    evaluation = F.col("role") == "assistant"
    entry = F.struct(
        F.col("turn").alias("step"),
        F.when(~evaluation, size).alias("loss"),
        F.when(evaluation, size).alias("eval_bleu"),
    )
    part = F.floor(F.col("turn") / 100).alias("part")
    states = t.groupBy(F.col("conv_id").alias("run_id"), part).agg(
        F.sort_array(F.collect_list(entry)).alias("log_history")
    )
    return states.drop("part")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, id): the words of the documents with their first place as id; one-letter words are
    left to the unknown id."""
    w = documents(spark, sf_dir).select(
        "doc_id", F.posexplode(words(F.col("text"))).alias("pos", "word")
    )
    return (
        w.filter(F.char_length("word") > 1)
        .groupBy("word")
        .agg(F.min(F.col("doc_id") * 100000 + F.col("pos") + 10).alias("id"))
    )
