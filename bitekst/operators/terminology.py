"""Glossary, term search, term marking and term accuracy.

A term can only match where its text is a run of whole pieces (runs of word and of non-word
characters), because both its ends are word boundaries. A glossary of a measured size is sent to the
workers, and one walk over a text's pieces finds all its terms. With a larger one the search is an
equi-join: the distinct piece sequences of a text, of the lengths that occur in the glossary, against
the terms.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitekst.functions.fuzzy import as_lists, rate_rows, similar_terms
from bitekst.functions.patterns import Patterns
from bitekst.functions.text import (
    WORD,
    literal_replacement,
    pieces,
    strip,
    whole_word_pattern,
)
from bitekst.operators.scoring import beside, evaluate_all
from bitekst.session import broadcast_if_small, materialize, size_in_bytes

# The marks, and the similarity from which a term counts as found.
TERM_START, TERM_END = "<TERM>", "</TERM>"
FUZZY_THRESHOLD = 0.80


def glossary_load(entries: DataFrame, source_side: str = "en", order: str = "ord") -> DataFrame:
    """entries(order, en, no) → glossary(src_term, tgt_term, ord).

    Blank sides are dropped, terms are lower-cased, the last of equal source terms wins, and
    ``ord`` is the place of the first one.
    """
    target_side = "no" if source_side == "en" else "en"
    terms = entries.select(
        F.lower(strip(F.coalesce(F.col(source_side), F.lit("")))).alias("src_term"),
        F.lower(strip(F.coalesce(F.col(target_side), F.lit("")))).alias("tgt_term"),
        F.col(order).alias("place"),
    ).filter("src_term <> '' and tgt_term <> ''")
    return terms.groupBy("src_term").agg(
        F.max_by("tgt_term", "place").alias("tgt_term"), F.min("place").alias("ord")
    )


def glossary_inverse(glossary: DataFrame) -> DataFrame:
    """The glossary read from target to source; the last of equal targets wins."""
    return glossary.groupBy(F.col("tgt_term").alias("src_term")).agg(
        F.max_by("src_term", "ord").alias("tgt_term"), F.min("ord").alias("ord")
    )


# Pieces of a term that make its join key: word, gap, word.
KEY_PIECES = 3
# Stands between pieces where they are compared as one text.
_GAP = "\x01"


def _core(text: str) -> Column:
    """The lower-cased text without non-word characters at its ends."""
    return F.regexp_replace(
        F.lower(F.coalesce(F.col(text), F.lit(""))), rf"\A[^{WORD}]+|[^{WORD}]+\z", ""
    )


def _phrases(df: DataFrame, row_id: str, text: str, sizes: Column) -> DataFrame:
    """(row_id, key): the different runs of as many pieces as ``sizes`` (an array) says."""
    cut = df.select(F.col(row_id), pieces(_core(text)).alias("p"), sizes.alias("m"))

    def runs_of(size: Column) -> Column:
        fits = F.filter("p", lambda _, i: i + size <= F.size("p"))
        return F.transform(fits, lambda _, i: F.array_join(F.slice(F.col("p"), i + 1, size), ""))

    runs = F.array_distinct(F.flatten(F.transform("m", runs_of)))
    return cut.select(row_id, F.explode(runs).alias("key"))


def _joined_pieces(p: Column) -> Column:
    return F.concat(F.lit(_GAP), F.array_join(p, _GAP), F.lit(_GAP))


def _hits(df: DataFrame, terms: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, columns of terms(term, …)) of the terms that occur in the row as whole words.

    Joined on the first pieces of a term, so a text emits its short runs only, however long terms
    are. A longer term is then looked for in those rows whose texts have its beginning.
    """
    p = pieces(F.col("term"))
    keyed = terms.select(
        "*", F.array_join(F.slice(p, 1, KEY_PIECES), "").alias("key"), (F.size(p) > KEY_PIECES).alias("more"),
        F.least(F.size(p), F.lit(KEY_PIECES)).alias("pieces"),
    )
    keyed = broadcast_if_small(keyed)
    sizes = keyed.agg(F.collect_set("pieces")).scalar()
    found = _phrases(df, row_id, text, sizes).join(keyed, "key")
    whole = found.filter("not more").select(row_id, *terms.columns)
    begun = found.filter("more").groupBy(row_id).agg(F.collect_list(F.struct(*terms.columns)).alias("t"))
    rows = df.select(row_id, _joined_pieces(pieces(_core(text))).alias("x")).join(begun, row_id)
    there = F.filter("t", lambda t: F.contains(F.col("x"), _joined_pieces(pieces(t["term"]))))
    return whole.unionByName(rows.select(row_id, F.inline(there)))


# Texts of a batch that are Python objects at a time.
TEXTS = 256

# Largest measured size of a glossary that every worker holds: a few hundred thousand terms.
WALK_BYTES = 16 * 1024 * 1024


def _sent(terms: DataFrame, most: int) -> Broadcast | None:
    """The terms for the workers, or nothing if they are more than ``most`` bytes."""
    terms = materialize(terms)
    if size_in_bytes(terms) > most:
        return None
    return terms.sparkSession.sparkContext.broadcast({"table": terms.toArrow()})


def _patterns(sent: Broadcast) -> Patterns:
    """The walk over the sent terms; a worker builds it once and keeps it with them."""
    held = sent.value
    if "patterns" not in held:
        held["patterns"] = Patterns(held["table"], TERM_START, TERM_END)
    return held["patterns"]


def extract_terms(
    df: DataFrame,
    glossary: DataFrame,
    row_id: str = "pair_id",
    text: str = "source",
    walk_bytes: int = WALK_BYTES,
) -> DataFrame:
    """(row_id, term, ord): every glossary source term that occurs in the row as whole words."""
    terms = glossary.select(F.col("src_term").alias("term"), "ord")
    sent = _sent(terms, walk_bytes)
    if sent is None:
        return _hits(df, terms, row_id, text)

    @F.arrow_udf(T.ArrayType(terms.schema))
    def found(texts: pa.Array) -> pa.Array:
        return _patterns(sent).found(texts)

    return df.select(row_id, found(text).alias("found")).select(row_id, F.inline("found"))


def _terms_with_marks(glossary: DataFrame) -> DataFrame:
    term = F.col("src_term")
    return glossary.select(
        term.alias("term"), "ord", whole_word_pattern(term).alias("pattern"),
        F.concat(F.lit(TERM_START), literal_replacement(term), F.lit(TERM_END)).alias("mark"),
    )


def _marked(sent: Broadcast, text: Column, nested: bool) -> Column:
    """The marked text, row by row: spliced from the places of the terms. Rows in which a term can
    occur in a mark have their terms replaced one after the other."""
    steps = T.StructType().add("pattern", T.StringType()).add("mark", T.StringType())

    @F.arrow_udf(T.StructType().add("text", T.StringType()).add("later", T.ArrayType(steps)))
    def splice(texts: pa.Array) -> pa.Array:
        walk = _patterns(sent)
        steps = walk.table.select(["pattern", "mark"]).combine_chunks().to_struct_array().combine_chunks()
        offsets, rows, done = [0], [], []
        for start in range(0, len(texts), TEXTS):  # a few texts at a time are Python objects
            part = [walk.marked(t.as_py(), nested) for t in texts[start : start + TEXTS]]
            for _, later in part:
                rows += later
                offsets.append(len(rows))
            done.append(pa.array([t for t, _ in part], pa.string()))
        later = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps.take(pa.array(rows, pa.int64())))
        marked = pa.concat_arrays(done) if done else pa.array([], pa.string())
        return pa.StructArray.from_arrays([marked, later], ["text", "later"])

    done = splice(text)
    one_by_one = F.aggregate(
        done["later"], done["text"], lambda acc, t: F.regexp_replace(acc, t["pattern"], t["mark"])
    )
    return F.when(F.size(done["later"]) > 0, one_by_one).otherwise(done["text"])


def _candidates(
    df: DataFrame, glossary: DataFrame, row_id: str, text: str
) -> DataFrame:
    """Per row the terms to mark, longest first, then in glossary order, with their patterns.

    Terms with a sign or the word of the mark match once something is marked. Those of nothing else
    are a handful of texts and tried in every row that has a hit; the others are tried where their
    first other word stands.
    """
    terms = _terms_with_marks(glossary)
    by_length = F.struct((-F.char_length("term")).alias("neg"), "ord", "term", "pattern", "mark").alias("t")
    found = _hits(df, terms, row_id, text).select(row_id, by_length)
    like_mark = F.rlike("term", F.lit(rf"[<>]|(\A|[^{WORD}])term([^{WORD}]|\z)"))
    special = terms.filter(like_mark).withColumn(
        "anchor",
        F.get(F.filter(pieces(F.col("term")), lambda x: F.rlike(x, F.lit(f"[{WORD}]")) & (x != "term")), F.lit(0)),
    )
    anchored = broadcast_if_small(special.filter("anchor is not null"))
    tried = _phrases(df, row_id, text, F.array(F.lit(1))).join(
        anchored, F.col("key") == F.col("anchor")
    ).select(row_id, by_length)
    marks = special.filter("anchor is null").agg(F.collect_list(by_length)).scalar()
    grouped = (
        found.select(row_id, "t", F.lit(True).alias("hit"))
        .unionByName(tried.select(row_id, "t", F.lit(False).alias("hit")))
        .groupBy(row_id)
        .agg(F.collect_set("t").alias("found"), F.max("hit").alias("hit"))
        .filter("hit")
    )
    return grouped.select(row_id, F.sort_array(F.array_union("found", marks)).alias("candidates"))


def mark_terms(
    df: DataFrame,
    glossary: DataFrame,
    row_id: str = "pair_id",
    text: str = "source",
    out: str | None = None,
    nested: bool = True,
    walk_bytes: int = WALK_BYTES,
) -> DataFrame:
    """Wrap every hit as ``<TERM>term</TERM>`` in the lower-cased glossary form.

    The result is that of replacing one term after the other, so a short term is also marked inside
    the mark of a longer one. With ``nested=False`` only the left-most longest hits are marked.
    """
    out = out or text
    sent = _sent(_terms_with_marks(glossary), walk_bytes)
    if sent is not None:
        return df.withColumn(out, _marked(sent, F.col(text), nested))
    candidates = _candidates(df, glossary, row_id, text)

    if nested:
        value = F.aggregate(
            "candidates",
            F.col(text),
            lambda acc, t: F.regexp_replace(acc, t["pattern"], t["mark"]),
        )
    else:
        any_term = F.array_join(
            F.transform("candidates", lambda t: t["pattern"]), "|"
        )
        value = F.regexp_replace(
            F.col(text), F.concat(F.lit("("), any_term, F.lit(")")), f"{TERM_START}$1{TERM_END}"
        )
    joined = df.join(candidates, row_id, "left")
    return joined.withColumn(
        out, F.when(F.col("candidates").isNotNull(), value).otherwise(F.col(text))
    ).drop("candidates")


def override(base: Column, extra: Column) -> Column:
    """Merge two maps; entries of ``extra`` win."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(extra), k))
    return F.map_concat(kept, extra)


def mark_pairs(
    df: DataFrame,
    glossary: DataFrame,
    row_id: str = "pair_id",
    mark_source: bool = True,
    mark_target: bool = True,
) -> DataFrame:
    """Mark both sides and note it in the metadata."""
    out = df
    if mark_source:
        out = mark_terms(out, glossary, row_id, "source")
    if mark_target:
        out = mark_terms(out, glossary_inverse(glossary), row_id, "target")
    empty = F.create_map().cast("map<string,string>")
    note = F.create_map(F.lit("terminology_marked"), F.lit("true"))
    return out.withColumn("metadata", override(F.coalesce("metadata", empty), note))


def term_stats(
    df: DataFrame, glossary: DataFrame, row_id: str = "pair_id", text: str = "source"
) -> DataFrame:
    """Coverage of a corpus by the glossary, one line."""
    per_row = (
        extract_terms(df, glossary, row_id, text).groupBy(row_id).agg(F.count("*").alias("n"))
    )
    hits = per_row.agg(
        F.count("*").alias("samples_with_terms"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_term_occurrences"),
    )
    total = df.agg(F.count("*")).scalar()
    size = glossary.agg(F.count("*")).scalar()
    return hits.withColumns({"total_samples": total, "glossary_size": size}).select(
        "total_samples",
        "samples_with_terms",
        "total_term_occurrences",
        F.coalesce(
            F.try_divide(F.col("total_term_occurrences"), F.col("total_samples")), F.lit(0.0)
        ).alias("avg_terms_per_sample"),
        "glossary_size",
    )


def _unique(df: DataFrame, row_id: str) -> bool:
    """Whether no id comes twice (null is one, too); reads the ids only."""
    return df.groupBy(row_id).count().filter("count > 1").isEmpty()


def _once(walk: Callable[..., Column]) -> Callable[..., Column]:
    """The function as one that is not made again for a filter on what it returns, below a join or a
    repartition: texts would be walked twice, the first time by the few tasks of a small file."""
    return walk.asNondeterministic()


def _target_numbers(sent: Broadcast) -> dict:
    """What is sent, with the different targets of the sent terms, the number of the target of every
    term and the walk over the targets."""
    held = sent.value
    if "targets" not in held:
        target = held["table"]["tgt_term"].combine_chunks()
        different = target.unique()
        table = pa.table({"term": different, "ord": pa.array(range(len(different)), pa.int64())})
        held["number"] = pc.index_in(target, different).to_pylist()
        held["different"] = different
        held["targets"] = Patterns(table, TERM_START, TERM_END)
    return held


def expected_terms(
    df: DataFrame,
    glossary: DataFrame,
    row_id: str = "pair_id",
    text: str = "source",
    walk_bytes: int = WALK_BYTES,
) -> DataFrame:
    """(row_id, term): distinct target terms of the source terms found in a row. Only rows with one id
    have to be brought together for that."""
    sent = _sent(glossary.select(F.col("src_term").alias("term"), "ord", "tgt_term"), walk_bytes)
    if sent is None:
        pairs = glossary.select(F.col("src_term").alias("term"), F.col("tgt_term"))
        hits = extract_terms(df, glossary, row_id, text, walk_bytes).join(broadcast_if_small(pairs), "term")
        return hits.select(row_id, F.col("tgt_term").alias("term")).distinct()

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def targets(texts: pa.Array) -> pa.Array:
        number, terms = _target_numbers(sent)["number"], _patterns(sent)
        offsets, wanted = [0], []
        for x in texts:
            wanted += {number[t] for t in terms.terms_of(x.as_py())}
            offsets.append(len(wanted))
        words = sent.value["different"].take(pa.array(wanted, pa.int64()))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)

    found = df.select(row_id, _once(targets)(text).alias("terms")).select(row_id, F.explode("terms").alias("term"))
    return found if _unique(df, row_id) else found.distinct()


def term_in_prediction(
    df: DataFrame,
    expected: DataFrame,
    glossary: DataFrame,
    row_id: str = "pair_id",
    hyp: str = "prediction",
    fuzzy: bool = True,
    threshold: float = FUZZY_THRESHOLD,
    walk_bytes: int = WALK_BYTES,
) -> DataFrame:
    """expected(row_id, term) with ``found``: a whole-word hit, else a similar enough passage."""
    if not fuzzy:
        return _whole_words(df, expected, glossary, row_id, hyp, walk_bytes)
    rated = _rated(df, expected, glossary, row_id, hyp, threshold, walk_bytes)
    return rated.select(row_id, "term", (F.col("whole") | F.col("found")).alias("found"))


def _targets(glossary: DataFrame) -> DataFrame:
    return glossary.groupBy(F.col("tgt_term").alias("src_term")).agg(F.min("ord").alias("ord"))


def _whole_words(
    df: DataFrame, expected: DataFrame, glossary: DataFrame, row_id: str, hyp: str, walk_bytes: int
) -> DataFrame:
    hits = extract_terms(df, _targets(glossary), row_id, hyp, walk_bytes)
    hits = hits.select(row_id, "term", F.lit(True).alias("hit"))
    return expected.join(hits, [row_id, "term"], "left").select(
        row_id, "term", F.coalesce("hit", F.lit(False)).alias("found")
    )


def _similar(df: DataFrame, open_terms: DataFrame, row_id: str, hyp: str, threshold: float) -> DataFrame:
    """(row_id, term, found, windows, compared) of the terms that are not there as whole words. One
    line per row is rated, so that the prediction travels once and not once per term."""
    open_terms = open_terms.groupBy(row_id).agg(F.collect_list("term").alias("terms"))
    texts = df.select(row_id, _lower(hyp).alias("text"))
    rated = open_terms.join(texts, row_id).select(
        row_id, "terms", similar_terms(F.col("terms"), F.col("text"), threshold).alias("r")
    )
    lines = F.arrays_zip("terms", "r.found", "r.windows", "r.compared")
    return rated.select(row_id, F.inline(lines)).toDF(row_id, "term", "found", "windows", "compared")


def _lower(hyp: str) -> Column:
    return F.lower(F.coalesce(F.col(hyp), F.lit("")))


def _rated(
    df: DataFrame, expected: DataFrame, glossary: DataFrame, row_id: str, hyp: str, threshold: float, walk_bytes: int
) -> DataFrame:
    """(row_id, term, whole, found, windows, compared) for the expected terms of a row: there as whole
    words, or else what the similarity check says. A prediction travels once, to the terms of its row,
    and is walked and compared there."""
    sent = _sent(_targets(glossary).select(F.col("src_term").alias("term"), "ord"), walk_bytes)
    if sent is None:
        checked = materialize(_whole_words(df, expected, glossary, row_id, hyp, walk_bytes))
        whole = checked.filter("found").withColumns({"whole": F.lit(True), "windows": F.lit(0), "compared": F.lit(0)})
        similar = _similar(df, checked.filter("not found"), row_id, hyp, threshold).withColumn("whole", F.lit(False))
        names = [row_id, "term", "whole", "found", "windows", "compared"]
        return whole.select(*names).unionByName(similar.select(*names))

    flags, numbers = T.ArrayType(T.BooleanType()), T.ArrayType(T.LongType())
    kind = T.StructType().add("whole", flags).add("found", flags).add("windows", numbers).add("compared", numbers)

    @F.arrow_udf(kind)
    def check(terms: pa.Array, texts: pa.Array) -> pa.Array:
        whole, rated = _checked(terms, texts, sent, threshold)
        rows = []
        for there, r in zip(whole, rated):
            r = iter(r)
            rows.append([(True, True, 0, 0) if t else (False, *next(r)) for t in there])
        return as_lists(rows, kind.names, [pa.bool_(), pa.bool_(), pa.int64(), pa.int64()])

    lists = expected.groupBy(row_id).agg(F.collect_list("term").alias("terms"))
    rated = lists.join(df.select(row_id, _lower(hyp).alias("text")), row_id)
    rated = rated.select(row_id, "terms", _once(check)("terms", "text").alias("r"))
    lines = F.arrays_zip("terms", *[f"r.{c}" for c in kind.names])
    rated = rated.select(row_id, F.inline(lines)).toDF(row_id, "term", *kind.names)
    if _unique(df, row_id):
        return rated
    # A term that one row of an id has as whole words is not looked for in the others.
    there = F.max("whole").over(Window.partitionBy(row_id, "term"))
    return rated.withColumn("there", there).filter(F.col("whole") | ~F.col("there")).drop("there")


def _checked(
    terms: pa.ListArray, texts: pa.Array, sent: Broadcast, threshold: float
) -> tuple[list[list[bool]], list[list[tuple[bool, int, int]]]]:
    """Whether each of the terms of a row is in its text as whole words; the similarity of the others."""
    walk = _patterns(sent)
    names = walk.table["term"].to_pylist()
    whole, offsets, wanted = [], [0], []
    for mine, text in zip(terms, texts):
        there = {names[t] for t in walk.terms_of(text.as_py())}
        mine = mine.as_py()
        whole.append([t in there for t in mine])
        wanted += [t for t in mine if t not in there]
        offsets.append(len(wanted))
    others = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(wanted, pa.string()))
    return whole, rate_rows(others, texts, threshold)


def fuzzy_windows(
    df: DataFrame,
    expected: DataFrame,
    glossary: DataFrame,
    row_id: str = "pair_id",
    hyp: str = "prediction",
    threshold: float = FUZZY_THRESHOLD,
    walk_bytes: int = WALK_BYTES,
) -> DataFrame:
    """What the similarity check takes, one line: terms not there as whole words, those found by
    similarity, windows of the texts, and windows that shared characters did not rule out."""
    return _rated(df, expected, glossary, row_id, hyp, threshold, walk_bytes).filter("not whole").agg(
        F.count("*").alias("open_terms"),
        F.count_if("found").alias("similar_terms"),
        F.coalesce(F.sum("windows"), F.lit(0)).alias("windows"),
        F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"),
    )


def _rated_in_row(
    df: DataFrame, sent: Broadcast, row_id: str, src: str, hyp: str, threshold: float
) -> DataFrame:
    """(row_id, term_count, correct_terms) of every row, if no id comes twice: nothing moves. A row
    without an id has no terms."""

    @F.arrow_udf(T.StructType().add("term_count", T.LongType()).add("correct_terms", T.LongType()))
    def count(source: pa.Array, prediction: pa.Array) -> pa.Array:
        held = _target_numbers(sent)
        terms, number, names = _patterns(sent), held["number"], held["different"].to_pylist()
        offsets, wanted, expected, correct = [0], [], [], []
        for x, y in zip(source, prediction):
            mine = {number[t] for t in terms.terms_of(x.as_py())}
            missing = mine.difference(held["targets"].terms_of(y.as_py())) if mine else mine
            expected.append(len(mine))
            correct.append(len(mine) - len(missing))
            wanted += [names[t] for t in missing]
            offsets.append(len(wanted))
        others = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(wanted, pa.string()))
        for i, rated in enumerate(rate_rows(others, prediction, threshold)):
            correct[i] += sum(found for found, _, _ in rated)
        counts = [pa.array(x, pa.int64()) for x in (expected, correct)]
        return pa.StructArray.from_arrays(counts, ["term_count", "correct_terms"])

    source = F.when(F.col(row_id).isNotNull(), F.col(src))
    counted = df.select(row_id, _once(count)(source, _lower(hyp)).alias("n"))
    return counted.select(row_id, "n.term_count", "n.correct_terms")


def _counted(df: DataFrame, sent: Broadcast, row_id: str, src: str, hyp: str) -> DataFrame:
    """(row_id, term_count, correct_terms) of the rows that have terms: both texts are walked where the
    row is, and only numbers of target terms move, as rows with one id count as one."""
    numbers = T.ArrayType(T.IntegerType())

    @F.arrow_udf(T.StructType().add("expected", numbers).add("found", numbers))
    def walk(source: pa.Array, prediction: pa.Array) -> pa.Array:
        terms, held = _patterns(sent), _target_numbers(sent)
        number, targets = held["number"], held["targets"]
        offsets, wanted, there = [0], [], []
        behind = [0]
        for i in range(len(source)):
            mine = {number[t] for t in terms.terms_of(source[i].as_py())}
            wanted += mine
            offsets.append(len(wanted))
            there += targets.terms_of(prediction[i].as_py())
            behind.append(len(there))
        lists = [
            pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(x, pa.int32()))
            for o, x in ((offsets, wanted), (behind, there))
        ]
        return pa.StructArray.from_arrays(lists, ["expected", "found"])

    rows = df.select(row_id, walk(src, hyp).alias("t")).select(row_id, "t.expected", "t.found")
    wanted, there = (F.array_distinct(F.flatten(F.collect_list(c))) for c in ("expected", "found"))
    sets = rows.groupBy(row_id).agg(wanted.alias("expected"), there.alias("found")).filter(F.size("expected") > 0)
    return sets.select(
        row_id,
        F.size("expected").cast("long").alias("term_count"),
        F.size(F.array_intersect("expected", "found")).cast("long").alias("correct_terms"),
    )


def term_accuracy_rows(
    df: DataFrame,
    glossary: DataFrame,
    row_id: str = "pair_id",
    src: str = "source",
    hyp: str = "prediction",
    fuzzy: bool = True,
    walk_bytes: int = WALK_BYTES,
) -> DataFrame:
    """Precision, recall, F1 and counts per row; 1, 1, 1, 0 for rows without terms."""
    sent = _sent(glossary.select(F.col("src_term").alias("term"), "ord", "tgt_term"), walk_bytes)
    if fuzzy and sent is not None and _unique(df, row_id):
        rows = _rated_in_row(df, sent, row_id, src, hyp, FUZZY_THRESHOLD)
    else:
        if sent is not None and not fuzzy:
            counts = _counted(df, sent, row_id, src, hyp)
        else:
            expected = expected_terms(df, glossary, row_id, src, walk_bytes)
            checked = term_in_prediction(df, expected, glossary, row_id, hyp, fuzzy, walk_bytes=walk_bytes)
            counts = checked.groupBy(row_id).agg(
                F.count("*").alias("term_count"), F.count_if("found").alias("correct_terms")
            )
        rows = df.select(row_id).join(counts, row_id, "left")
    # What is predicted is a part of what is expected, so precision is 1 by definition.
    recall = F.coalesce(F.try_divide("correct_terms", "term_count"), F.lit(1.0))
    return rows.select(
        row_id,
        F.lit(1.0).alias("term_precision"),
        recall.alias("term_recall"),
        (2 * recall / (1 + recall)).alias("term_f1"),
        F.coalesce("term_count", F.lit(0)).alias("term_count"),
        F.coalesce("correct_terms", F.lit(0)).alias("correct_terms"),
    )


def term_accuracy(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Micro accuracy and macro means over the rows that have terms; zeros if there are none."""

    def mean(name: str) -> Column:
        return F.coalesce(F.avg(name), F.lit(0.0)).alias(name)

    accuracy = F.try_divide(F.sum("correct_terms"), F.sum("term_count"))
    return (
        rows.filter("term_count > 0")
        .groupBy(*by)
        .agg(
            F.coalesce(accuracy, F.lit(0.0)).alias("term_accuracy"),
            mean("term_precision"),
            mean("term_recall"),
            mean("term_f1"),
            F.count("*").alias("sentences_with_terms"),
        )
    )


def evaluate_with_terms(
    df: DataFrame,
    glossary: DataFrame,
    row_id: str = "pair_id",
    src: str = "source",
    hyp: str = "prediction",
    ref: str = "reference",
    by: tuple[str, ...] = (),
    score: str | None = None,
    fuzzy: bool = True,
) -> DataFrame:
    """The scores of :func:`scoring.evaluate_all` and the term accuracy in one report."""
    report = evaluate_all(df, row_id, hyp, ref, by, score)
    rows = term_accuracy_rows(df, glossary, row_id, src, hyp, fuzzy)
    if by:
        rows = rows.join(df.select(row_id, *by), row_id)
    return beside([report, term_accuracy(rows, tuple(by))], tuple(by))
