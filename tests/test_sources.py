import json

import pytest
from pyspark.sql import functions as F

from bitekst.operators import corpus, encoding, inference, runs, scoring, terminology
from bitekst.sources import readers, writers

TMX = """<?xml version="1.0" encoding="UTF-8"?>
<tmx version="1.4"><header srclang="nb"/><body>
<tu tuid="1"><prop type="x">p</prop><tuv xml:lang="nb"><seg> Hei verden </seg></tuv><tuv xml:lang="en"><seg>Hello world</seg></tuv></tu>
<tu><tuv xml:lang="nb"><seg>Regional</seg></tuv><tuv xml:lang="en-US"><seg>Ignored</seg></tuv></tu>
<tu><tuv xml:lang="nb"><seg>Alene</seg></tuv></tu>
<tu><tuv xml:lang="nb"><seg>Tom</seg></tuv><tuv xml:lang="en"><seg></seg></tuv></tu>
<tu><tuv xml:lang="nb"><seg>Først</seg></tuv><tuv xml:lang="nb"><seg>Sist</seg></tuv><tuv xml:lang="en"><seg>Last</seg></tuv></tu>
<group><tu><tuv xml:lang="nb"><seg>a &amp; b &lt; c</seg></tuv><tuv xml:lang="en"><seg>R&amp;D</seg></tuv></tu></group>
<tu><tuv xml:lang="nb"><seg>før <bpt i="1">x</bpt> etter</seg></tuv><tuv xml:lang="en"><seg>before</seg></tuv></tu>
</body></tmx>
"""


def test_translation_memory(spark, tmp_path):
    path = tmp_path / "small.tmx"
    path.write_text(TMX, encoding="utf-8")
    got = {tuple(r)[1:] for r in readers.read_tmx(spark, str(path)).collect()}
    assert got == {
        ("Hei verden", "Hello world"),
        ("Sist", "Last"),
        ("a & b < c", "R&D"),
        ("før", "before"),
    }


def test_json_array(spark, tmp_path):
    path = tmp_path / "pairs.json"
    rows = [
        {"source": "a", "target": "b", "metadata": {"direction": "reverse"}},
        {"source": "c", "metadata": None},
        {"target": "d"},
    ]
    path.write_text(json.dumps(rows, indent=2), encoding="utf-8")
    got = readers.read_pairs_json(spark, str(path)).orderBy("pair_id").collect()
    assert [(r.source, r.target) for r in got] == [("a", "b"), ("c", ""), ("", "d")]
    assert [r.metadata for r in got] == [{"direction": "reverse"}, {}, {}]
    docs = readers.read_document_pairs(spark, str(path)).orderBy("doc_id").first()
    assert (docs.doc_id, docs.en_text, docs.no_text) == (1, "a", "b")


def test_glossary_file(spark, tmp_path):
    path = tmp_path / "glossary.json"
    rows = [{"en": "Oil", "no": "olje"}, {"en": " ", "no": "x"}, {"en": "oil", "no": "Råolje"}, {"en": "gas"}]
    path.write_text(json.dumps(rows), encoding="utf-8")
    got = terminology.glossary_load(readers.read_glossary(spark, str(path))).collect()
    assert [(r.src_term, r.tgt_term) for r in got] == [("oil", "råolje")]


def test_run_log(spark, tmp_path):
    state = {
        "best_metric": 0.6,
        "max_steps": 100,
        "log_history": [
            {"epoch": 0.1, "step": 50, "loss": 2.0, "learning_rate": 0.1},
            {"epoch": 0.2, "step": 100, "eval_bleu": 0.6, "eval_loss": 1.0},
        ],
    }
    (tmp_path / "state.json").write_text(json.dumps(state), encoding="utf-8")
    log = readers.read_run_logs(spark, str(tmp_path / "state.json"))
    rows = log.orderBy("step").collect()
    assert [(r.step, r.loss, r.eval_bleu) for r in rows] == [(50, 2.0, None), (100, None, 0.6)]
    assert runs.early_stop(log).first().best_step == 100


@pytest.fixture
def pairs(spark):
    rows = [(i, f"linje {i}", f"line {i}") for i in range(50)]
    rows += [(50, 'tab\t"q" æøå', " line\nbreak \\ "), (51, "", "x")]
    return spark.createDataFrame(rows, "pair_id long, source string, target string")


def lines(path):
    out = []
    for part in sorted(path.glob("part-*")):
        out.append(part.read_text(encoding="utf-8").splitlines())
    return out


def test_parallel_files_line_up(pairs, tmp_path):
    writers.export_pairs(pairs, str(tmp_path / "out"), "parallel")
    no, en = lines(tmp_path / "out.no"), lines(tmp_path / "out.en")
    assert [len(p) for p in no] == [len(p) for p in en]
    flat = list(zip(sum(no, []), sum(en, [])))
    assert flat[:2] == [("linje 0", "line 0"), ("linje 1", "line 1")]
    assert flat[50:] == [('tab\t"q" æøå', " line break \\ "), ("", "x")]


def test_tsv_round_trip(spark, pairs, tmp_path):
    writers.export_pairs(pairs, str(tmp_path / "t"), "tsv")
    back = spark.read.options(
        sep="\t", header=True, escape='"', multiLine=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(str(tmp_path / "t"))
    assert back.columns == ["norwegian", "english"]
    got = sorted((r.norwegian or "", r.english or "") for r in back.collect())
    assert got == sorted((r.source, r.target) for r in pairs.collect())


def test_json_outputs(pairs, tmp_path):
    writers.export_pairs(pairs, str(tmp_path / "j"), "jsonl")
    first = json.loads(lines(tmp_path / "j")[0][0])
    assert first == {"source": "linje 0", "target": "line 0", "source_lang": "nb", "target_lang": "en"}
    assert any("æøå" in x for part in lines(tmp_path / "j") for x in part)
    writers.export_pairs(pairs, str(tmp_path / "h"), "huggingface")
    assert json.loads(lines(tmp_path / "h")[0][0]) == {"translation": {"nb": "linje 0", "en": "line 0"}}
    writers.export_pairs(pairs, str(tmp_path / "f"), "fairseq")
    assert (tmp_path / "f.no").exists() and (tmp_path / "f.en").exists()


def test_unknown_format(pairs, tmp_path):
    with pytest.raises(ValueError, match="Unknown format"):
        writers.export_pairs(pairs, str(tmp_path / "x"), "docx")
    assert not (tmp_path / "x").exists()


def test_splits_round_trip(spark, pairs, tmp_path):
    writers.write_splits(corpus.create_splits(pairs), str(tmp_path / "s"))
    parts = readers.load_splits(spark, str(tmp_path / "s"))
    assert {k: v.count() for k, v in parts.items()} == dict(
        zip(("train", "val", "test"), corpus.split_sizes(52, 0.8, 0.1, 0.1))
    )
    small = readers.load_splits(spark, str(tmp_path / "s"), use_subset=5)
    assert small["train"].count() == 5
    assert small["train"].join(parts["train"], "pair_id", "left_anti").count() == 0


def test_results(spark, pairs, tmp_path):
    writers.write_results(pairs, str(tmp_path / "r"))
    assert (tmp_path / "r.csv").exists() and (tmp_path / "r.json").exists()
    writers.write_results(pairs.select(F.array("source").alias("a")), str(tmp_path / "n"))
    assert not (tmp_path / "n.csv").exists()


def test_predictions_keep_their_row(spark):
    df = spark.range(100).select(
        F.col("id").alias("pair_id"), F.concat(F.lit("t"), F.col("id")).alias("source")
    )

    def make():
        def model(texts):
            assert 0 < len(texts) <= 8
            return [t.upper() for t in texts]

        return model

    rows = inference.predict_batches(df.repartition(3), make).collect()
    assert sorted((r.pair_id, r.prediction) for r in rows) == [(i, f"T{i}") for i in range(100)]


def test_prediction_table_joins_by_id(spark):
    a = spark.createDataFrame([(2, "s2"), (1, "s1")], "pair_id long, source string")
    b = spark.createDataFrame([(1, "p1", "r1"), (2, "p2", "r2")], "pair_id long, prediction string, reference string")
    rows = scoring.prediction_table(a, b).orderBy("pair_id").collect()
    assert [tuple(r) for r in rows] == [(1, "s1", "p1", "r1"), (2, "s2", "p2", "r2")]


def test_encoding_and_padding(spark):
    vocabulary = spark.createDataFrame([("a", 10), ("b", 11)], "word string, id long")
    df = spark.createDataFrame(
        [(1, "a b x a", "b"), (2, "", "a a"), (3, "b", "")], "pair_id long, source string, target string"
    )
    coded = encoding.encode_pairs(df, vocabulary, max_tokens=3)
    rows = {r.pair_id: r for r in coded.collect()}
    assert (rows[1].input_ids, rows[1].attention_mask, rows[1].labels) == ([10, 11, 3], [1, 1, 1], [11])
    assert rows[2].input_ids == [] and rows[2].labels == [10, 10]
    padded = {r.pair_id: r for r in encoding.pad_batches(coded, 2).collect()}
    assert padded[2].input_ids == [1, 1, 1] and padded[2].attention_mask == [0, 0, 0]
    assert padded[1].labels == [11, -100]
    assert padded[3].batch_id == 1 and padded[3].input_ids == [11]
    back = encoding.pad_batches(coded, 2).select("pair_id", encoding.unpad(F.col("labels")).alias("l"))
    assert {r.pair_id: r.l for r in back.collect()} == {i: rows[i].labels for i in rows}


def test_row_numbers_do_not_depend_on_the_splits(spark, tmp_path):
    from bitekst.operators import corpus

    path = str(tmp_path / "pairs")
    table = spark.range(3000).select(
        F.concat(F.lit("source "), "id").alias("source"), F.concat(F.lit("target "), "id").alias("target")
    )
    table.repartition(3).write.json(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("128m", "8k", "3k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = readers.read_pairs_json(spark, path, lines=True)
            rows = {r.pair_id: r.source for r in df.collect()}
            assert sorted(rows) == list(range(3000))
            picked = {r.source for r in corpus.subset(df, 100).collect()}
            seen.append((rows, picked))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0] == seen[1] == seen[2]


def test_registry_grows_by_new_models_only(spark, tmp_path):
    from bitekst.operators import tracking

    runs = spark.createDataFrame([("e", 0.5), ("f", 0.6)], "experiment string, test_bleu double")
    models = tracking.register_model(
        runs, F.concat(F.lit("m-"), "experiment"), "root", F.lit("2026-01-02 03:04:05").cast("timestamp"),
        metrics=("test_bleu",), description="first",
    )
    path = str(tmp_path / "registry")
    tracking.append_models(models.filter("experiment = 'e'"), path)
    tracking.append_models(models, path)
    rows = sorted(tracking.read_models(spark, path).collect(), key=lambda r: r.id)
    assert [r.id for r in rows] == ["m-e_20260102_030405", "m-f_20260102_030405"]
    assert rows[0].description == "first" and rows[0].metrics == {"test_bleu": "0.5"} and rows[0].config == {}


def test_a_broken_registry_is_no_missing_one(spark, tmp_path):
    from py4j.protocol import Py4JJavaError

    from bitekst.operators import tracking

    assert tracking.read_models(spark, str(tmp_path / "none")) is None
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "part-0.parquet").write_text("not a table")
    with pytest.raises(Py4JJavaError):
        tracking.read_models(spark, str(tmp_path / "models")).collect()
