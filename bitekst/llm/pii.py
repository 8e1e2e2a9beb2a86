"""Personal data: candidates from generous generators, chosen by gradient-boosted trees.

Generators propose overlapping spans: the four base patterns, and looser forms of them (obfuscated
addresses, numbers with other separators or of other lengths, identity and account numbers). Every
candidate gets features of its format and of its context. Boosted trees learn from the candidates
themselves, weakly labelled by evidence that is no feature: the base checks, the base checks on the
normalised form, check digits, number ranges. A threshold per kind is calibrated on held-out
candidates of that kind; see ``choose`` for kinds with few of them. Base spans are always kept.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitekst.llm.common import by_batch, row_key, stored

#: The precision asked for, and the held-out candidates below which a kind has too few for a threshold.
PRECISION, FEW = 0.97, 60
TREES, DEPTH = 12, 3
#: More than a feature has values, so that all of them can split; Spark looks for these values in all
#: lines up to the square of this number.
BINS = 1024
#: Lines of different features that a task learns from.
LINES = 50000
AROUND = 32

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("email_like", "ip_like", "card_like", "phone_like", "account", "identity")
KINDS = (*BASE_KINDS, *MORE_KINDS)

# Base patterns. Possessive forms and the look-behind keep them linear in the text; they match the
# same spans, as what follows a run of digits or dots is never a digit.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# Looser forms.
LOOSE = {
    "email_like": re.compile(
        r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+"
        r"(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}+)+"
    ),
    "ip_like": re.compile(
        r"(?<![0-9.])[0-9]{1,5}+(?:(?:[.:]|\x20?[\[({](?:\.|dot)[\])}]\x20?|\x20dot\x20)[0-9]{1,5}+){3,5}"
    ),
    "card_like": re.compile(r"(?<![0-9])[0-9]{3,6}+(?:[\x20./_-]?[0-9]{2,6}+){2,6}"),
    "phone_like": re.compile(r"(?<![0-9])(?:\(?[0-9]{2,5}\)?[\x20./-]{1,2}){1,4}[0-9]{3,8}+(?![0-9])"),
    "account": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "identity": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
}
#: The base kind a loose kind stands for.
STANDS_FOR = {"email_like": "email", "ip_like": "ip", "card_like": "card", "phone_like": "phone"}
#: Endings of addresses.
ENDINGS = frozenset(
    "com org net edu gov mil int info biz io dev app co eu uk us ca au de fr es it nl pl pt br ru cn jp kr in ch at be se "
    "no dk fi cz ie nz za mx ar tr ua gr ro hu example test".split()
)
AT = re.compile(r"\x20?(?:[(\[{]at[)\]}]|\x20at\x20|(?<=\x20)at\x20)\x20?")
DOT = re.compile(r"\x20?(?:[(\[{](?:dot|\.)[)\]}]|\x20dot\x20|(?<=\x20)dot\x20)\x20?")
DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}")
SPELLED = re.compile(r"[(\[{](?:at|dot|\.)[)\]}]|\x20dot\x20")
CONTEXT = {
    "c_mail": ("mail", "contact", "write to", "@"),
    "c_phone": ("phone", "tel", "call", "mobile", "fax"),
    "c_card": ("card", "visa", "credit", "payment"),
    "c_host": ("ip", "host", "server", "address"),
    "c_person": ("born", "birth", "ssn", "passport", "name", "id"),
    "c_code": ("version", "v.", "http", "0x", "=", "#"),
}
FEATURES = (
    "length", "digits", "letters", "groups", "longest", "blanks", "dots", "dashes", "spelled", "brackets",
    "before_letter", "after_letter", "before_digit", "after_digit", "before_mark", *CONTEXT, "form",
)
_DIGITS = bytes(48 if 48 <= i < 58 else 32 for i in range(256))


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; every ``@`` is looked at once, so the time is linear."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by kind, then start."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    out = [(s, e, "email") for s, e in _emails(text)] if b"@" in raw else []
    if b"0" not in raw.translate(_DIGITS):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((*m.span(), "card"))
    for m in PHONE.finditer(text) if b"+" in raw else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return out


def evidence(kind: str, span: str) -> bool:
    """Whether a loose span passes the checks of its kind; none of them is a feature.

    Addresses and hosts have to pass the base pattern once marks are written plainly (addresses with
    a known ending), cards the check digit, account numbers the remainder 97, identity numbers the
    ranges that are issued, telephone numbers a trunk zero or the ranges of a ten-digit plan.
    """
    digits = "".join(re.findall("[0-9]", span))
    if kind == "email_like":
        plain = DOT.sub(".", AT.sub("@", span))
        return _emails(plain) == [(0, len(plain))] and plain.rpartition(".")[2] in ENDINGS
    if kind == "ip_like":
        m = re.fullmatch(r"((?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3})(?::([0-9]+))?", DOT.sub(".", span))
        return bool(m) and all(int(p) <= 255 for p in m[1].split(".")) and int(m[2] or 0) <= 65535
    if kind == "card_like":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "account":
        plain = span.replace(" ", "")
        return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "identity":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if DATE.search(span):
        return False
    ten = len(digits) == 10 and [len(g) for g in re.findall("[0-9]+", span)] == [3, 3, 4]
    return (digits[0] == "0" and 9 <= len(digits) <= 12) or (ten and digits[0] in "23456789" and digits[3] in "23456789")


def candidates(text: str, base: list[tuple[int, int, str]], raw: bytes) -> list[tuple[int, int, str, bool, bool]]:
    """The base spans and the loose spans that overlap none of them: start, end, kind, whether it is
    a base span, whether there is evidence for it. Loose spans may overlap one another."""
    out = [(s, e, k, True, True) for s, e, k in base]
    low = raw.lower()
    digits = b"0" in raw.translate(_DIGITS)
    covered = sorted((s, e) for s, e, _ in base)
    for kind, pattern in LOOSE.items():
        if not (digits if kind != "email_like" else b"at)" in low or b"at]" in low or b"at}" in low or b" at " in low):
            continue
        at = last = 0  # base spans that start before the candidate ends, and where the last of them ends
        for m in pattern.finditer(text):
            start, end = m.span()
            while at < len(covered) and covered[at][0] < end:
                last = max(last, covered[at][1])
                at += 1
            if last <= start:
                out.append((start, end, kind, False, evidence(kind, m[0])))
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span = text[start:end]
    groups = re.findall(r"[0-9]+", span[:200])
    before, after = text[max(0, start - AROUND) : start], text[end : end + 1]
    context = (before + " " + text[end : end + AROUND // 2]).lower()
    form = KINDS.index(STANDS_FOR.get(kind, kind))
    last = before[-1:]
    return [
        float(x)
        for x in (
            min(len(span), 200), sum(map(len, groups)), sum(c.isalpha() for c in span[:200]), len(groups),
            max(map(len, groups), default=0), span.count(" "), span.count("."), span.count("-"),
            len(SPELLED.findall(span[:200])), "(" in span or "[" in span,
            last.isalpha(), after.isalpha(), last.isdigit(), after.isdigit(), bool(last) and last in "=:#\"'/_.-",
            *(any(w in context for w in words) for words in CONTEXT.values()), form,
        )
    ]


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def make():
        def one(text):
            if not text:
                return [], []
            raw = text.encode("utf-8", "surrogatepass")
            base = base_spans(text, raw)
            proposed = candidates(text, base, raw)
            return (
                [{"start": s, "end": e, "kind": k} for s, e, k in base],
                [
                    {"start": s, "end": e, "kind": k, "base": b, "sure": sure, "x": features(text, s, e, k)}
                    for s, e, k, b, sure in proposed
                ],
            )

        def run(b):
            done = [one(t) for t in b["text"]]
            return {"doc_id": b["doc_id"], "row": b["row"], "base": [d[0] for d in done], "proposed": [d[1] for d in done]}

        return run

    texts = docs.select(
        docs[id_col].cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), docs[text_col].alias("text")
    )
    span = "start: long, end: long, kind: string"
    return by_batch(
        texts, make,
        f"doc_id long, row long, base array<struct<{span}>>, proposed array<struct<{span}, base: boolean, sure: boolean, x: array<double>>>",
    )


def _vectors(spans: DataFrame) -> DataFrame:
    columns = [F.get("x", F.lit(i)).alias(f"x_{n}") for i, n in enumerate(FEATURES)]
    wide = spans.select("*", *columns)
    out = VectorAssembler(inputCols=[f"x_{n}" for n in FEATURES], outputCol="features").transform(wide)
    return out.drop(*[f"x_{n}" for n in FEATURES])


def _limits(scored: DataFrame, precision: float, least: int = 20) -> dict[str, tuple[int, float | None]]:
    """Per kind the number of held-out candidates, and the lowest score from which on at least ``least``
    of them are right often enough. ``scored`` has (kind, p, n, right); one task sees the different
    scores of a kind."""
    by_score = scored.groupBy("kind", "p").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))
    down = Window.partitionBy("kind").orderBy(F.desc("p"))
    upto = by_score.select("kind", "p", "n", F.sum("n").over(down).alias("all"), F.sum("right").over(down).alias("good"))
    enough = (F.col("all") >= least) & (F.col("good") / F.col("all") >= precision)
    found = upto.groupBy("kind").agg(F.sum("n").alias("n"), F.min(F.when(enough, F.col("p"))).alias("limit"))
    return {r["kind"]: (r["n"], r["limit"]) for r in found.collect()}


def choose(spans: DataFrame, precision: float = PRECISION) -> DataFrame:
    """(doc_id, row, start, end, kind, p): the loose candidates that trees and thresholds select.

    All candidates take part, two thirds (by a hash) to learn from and a third to calibrate on; those
    with the same features, kind and label are one line with their number, and every kind weighs the
    same. A kind with at least ``FEW`` held-out candidates has its own threshold, the lowest score at
    which they are precise enough, or adds nothing if there is none. With fewer the trees have to find
    a candidate likely (0.5), and it needs evidence besides. If all candidates have the same label
    nothing can be learned, and the evidence decides alone.
    """
    loose = spans.filter("not base")
    counts = {r["kind"]: r["count"] for r in spans.groupBy("kind").count().collect()}
    empty = loose.filter("false").select("doc_id", "row", "start", "end", "kind", F.lit(0.0).alias("p"))
    if not set(counts) - set(BASE_KINDS):
        return empty
    held = F.pmod(F.xxhash64("doc_id", "row", "start", "end", "kind"), F.lit(3)) == 0
    label = F.col("sure").cast("double").alias("label")
    lines = spans.groupBy("x", "kind", "base", label, held.alias("held")).agg(F.count("*").alias("n"))
    lines = stored(lines, "vectors")
    train = lines.filter("not held")
    seen = train.agg(F.count("*").alias("lines"), F.sum("n").alias("n"), F.countDistinct("label").alias("labels")).first()
    if seen["labels"] < 2:
        return loose.filter("sure").select("doc_id", "row", "start", "end", "kind", F.lit(1.0).alias("p"))
    total = train.groupBy("kind").agg(F.sum("n").alias("of_kind"))
    train = train.join(F.broadcast(total), "kind").withColumn(
        "weight", F.col("n") * F.lit(seen["n"] / len(counts)) / F.col("of_kind")
    )
    # In a fixed order, as sums of doubles depend on it.
    train = train.repartitionByRange(-(-seen["lines"] // LINES), "x", "kind", "label").sortWithinPartitions("x", "kind", "label")
    model = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, seed=1, maxBins=BINS, minInstancesPerNode=1, weightCol="weight",
        minWeightFractionPerNode=min(5 / seen["n"], 0.49),
    )
    model = model.fit(_vectors(train))
    probability = vector_to_array("probability")[1].alias("p")
    check = _vectors(lines.filter("held and not base"))
    right = (F.col("n") * F.col("label")).alias("right")
    limits = _limits(model.transform(check).select("kind", probability, "n", right), precision)
    passed = F.lit(False)
    for kind in sorted(set(counts) - set(BASE_KINDS)):
        n, limit = limits.get(kind, (0, None))
        sure = F.lit(True)
        if n < FEW:
            limit, sure = 0.5, F.col("sure")
        if limit is not None:
            passed = passed | ((F.col("kind") == kind) & (F.col("p") >= limit) & sure)
    scored = model.transform(_vectors(loose)).select("doc_id", "row", "start", "end", "kind", "sure", probability)
    return scored.filter(passed).drop("sure")


def apart(spans: list[dict]) -> list[dict]:
    """Spans that do not overlap: from the left, of those with one start the longest, of equal ones
    the likeliest, then the first by kind."""
    out, last = [], 0
    for x in sorted(spans, key=lambda x: (x["start"], -x["end"], -x["p"], x["kind"])):
        if x["start"] >= last:
            out.append({"start": x["start"], "end": x["end"], "kind": x["kind"]})
            last = x["end"]
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, more), one row per row of ``docs``: start, end (code points, end exclusive)
    and kind of the base spans by kind, then start, and of the spans that the trees add by start,
    which overlap neither base spans nor one another.

    Null and empty texts have none, an empty table gives no rows. Texts of any length are read whole,
    in time proportional to it but for sorting their spans. Rows equal in doc_id and text get equal
    results, equal scores are settled by ``apart``; further columns of ``docs`` are not looked at.
    """
    found = stored(_found(docs, id_col, text_col), "candidates")
    spans = found.select("doc_id", "row", F.inline("proposed"))
    more = choose(spans).groupBy("doc_id", "row").agg(
        F.collect_set(F.struct("start", "end", "kind", "p")).alias("more")
    )
    span = "start: long, end: long, kind: string"
    more = by_batch(
        more, lambda: lambda b: {"id": b["doc_id"], "key": b["row"], "more": [apart(m) for m in b["more"]]},
        f"id long, key long, more array<struct<{span}>>",
    )
    on = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("key"))
    return found.join(more, on, "left").select("doc_id", "base", F.coalesce("more", F.array()).alias("more"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the personal data of all documents."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    mark = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    joined = lambda xs: F.array_join(F.transform(xs, mark), ",")
    keyed = F.transform("more", lambda x: F.struct(order[x["kind"]], x["start"], x["end"], x["kind"].alias("kind")))
    more = F.transform(
        F.array_sort(keyed),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")),
    )
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", more)).alias("spans"),
        F.size("more").cast("long").alias("n_more"),
    )
