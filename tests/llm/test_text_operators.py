import random
from collections import Counter

from bitekst.llm import decontam, lines, spans
from tests.llm import odd


def test_lines_odd(spark):
    docs = odd.documents(spark)
    out = lines.drop_boilerplate(docs, ratio=0.3, min_pages=2, dropped="gone")
    assert out.columns == [*docs.columns, "gone"]
    rows = out.collect()
    assert len(rows) == docs.count()
    by_text = Counter((r["doc_id"], r["text"], r["gone"]) for r in rows)
    # two of five pages of site a have both lines
    assert by_text[(1, "", 2)] == 2
    assert by_text[(2, None, 0)] == 1 and by_text[(3, "", 0)] == 1 and by_text[(4, " \n\t ", 0)] == 1
    assert by_text[(6, odd.LONG, 0)] == 1
    assert by_text[(None, None, 0)] == 1


def test_lines_by_site(spark):
    rows = [(i, "menu\nbody %d\n\n menu " % i, "a") for i in range(6)] + [(9, "menu\nx", "b"), (10, "y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(docs, ratio=0.5, min_pages=3).collect()}
    assert out[0] == "body 0\n"
    assert out[9] == "menu\nx"


def test_lines_empty(spark):
    assert lines.drop_boilerplate(odd.documents(spark, [])).count() == 0


def test_pieces_cover_the_text():
    for _, text, *_ in odd.TEXTS:
        raw = (text or "").encode()
        assert b"".join(spans.pieces(raw)) == raw
    assert spans.pieces(b"A b. C 3.5 d!? E") == [b"A b. ", b"C 3.5 d!? ", b"E"]


def test_runs_are_the_shortest():
    sizes = [3, 1, 5, 0, 9, 2]
    long = [(i, j) for i in range(6) for j in range(i + 1, 6) if sum(sizes[i : j + 1]) >= 8]
    want = {(i, min(j for a, j in long if a == i)) for i, _ in long}
    want |= {(max(i for i, b in long if b == j), j) for _, j in long}
    assert spans.runs(sizes, 2, 8) == sorted(want)


def test_spans_against_all_runs(spark):
    """Whatever any repeated run covers goes, the ends of repeated passages too."""
    rng = random.Random(3)
    words = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 1, 2, 4, 7))))
    pool = [words() + ". " for _ in range(14)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(2, 7))] for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else [rng.choice(pool)] for _ in range(rng.randint(0, 6))]
        texts.append([p for part in parts for p in part])
    seen, gone = {}, [set() for _ in texts]
    for n, text in enumerate(texts):
        for i in range(len(text)):
            for j in range(i + 1, len(text)):
                run = "".join(text[i : j + 1])
                if len(run.split()) >= 6 and seen.setdefault(run, (n, i)) != (n, i):
                    gone[n].update(range(i, j + 1))
    want = [(n, len(g), "".join(p for k, p in enumerate(t) if k not in g)) for n, (t, g) in enumerate(zip(texts, gone))]
    docs = spark.createDataFrame([(n, "".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    out = spans.remove_repeated(docs, 2, 6).select("doc_id", "n_removed", "text")
    assert sorted(map(tuple, out.collect())) == want
    assert sum(map(len, gone)) > 50


def test_spans_tail_and_leading_space(spark):
    shared = "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda rho sigma. Short end. Tiny."
    alone = " \n Some words that stand here only once ever. And some more of them at the end."
    rows = [(1, f"First text. {shared}"), (2, f"Second text of another kind. {shared}"), (3, alone)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in spans.remove_repeated(docs).collect()}
    assert out == {1: rows[0][1], 2: "Second text of another kind. ", 3: alone}


def test_spans_odd(spark):
    docs = odd.documents(spark)
    out = spans.remove_repeated(docs, 2, 5)
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {(r["doc_id"], r["text"]): r for r in rows}
    assert by[(2, None)]["n_sentences"] == 0
    assert by[(3, "")]["n_removed"] == 0
    # equal rows are one document: the first place of their run is in both
    assert sum(r["doc_id"] == 1 and r["n_removed"] == 0 for r in rows) == 3
    assert spans.remove_repeated(odd.documents(spark, [])).count() == 0


def test_spans_keep_the_first(spark):
    passage = "The quick brown fox runs over the hill. It sleeps beside the old grey barn at night."
    rows = [
        (3, f"Something else stands here. {passage} And an end that differs."),
        (1, f"An own beginning of the text. {passage}"),
        (2, f"{passage} {passage}"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in spans.remove_repeated(docs).collect()}
    assert out[1] == rows[1][1]
    assert out[2] == ""
    assert out[3] == "Something else stands here. And an end that differs."


ITEM = (
    "Tom has 12 apples and gives 5 apples to Anna. How many apples does Tom have after Anna returns 2 of them "
    "in the evening and how far is it if they walk 3 km to the old market"
)


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_template_slots(spark):
    swapped = ITEM.replace("Tom", "Ben").replace("Anna", "Eva").replace("12", "40").replace("km", "miles")
    mixed = ITEM.replace("Tom have", "Carl have").replace("5", "12")
    docs = documents(
        spark,
        [
            f"we read: and then {ITEM.lower().replace('tom', 'Tom').replace('anna', 'Anna')} in a book",
            f"we read: and then {swapped} in a book",
            f"we read: and then {mixed} in a book",
            "nothing of that kind is found in this other text about the market",
            " ".join(ITEM.split()[:15]),
        ],
    )
    bench = spark.createDataFrame([(70, ITEM), (71, ITEM), (72, None), (73, "too short")], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontam.contaminated(docs, bench).collect()}
    assert set(out) == {0, 1}
    assert {r["item_id"] for r in out.values()} == {70}
    assert out[0]["n_changed"] == 0
    assert out[1]["n_changed"] > 0


def test_template_odd(spark):
    docs = odd.documents(spark)
    bench = spark.createDataFrame([(1, "A text without a number. It has two sentences."), (2, "")], "item_id long, text string")
    out = decontam.contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in out] == [(None, 1, 1.0)]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(docs, none).count() == 0
    assert decontam.contaminated(odd.documents(spark, []), bench).count() == 0
