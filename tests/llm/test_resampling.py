import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from bitekst.llm import resampling
from tests.llm.odd import TEXTS, documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs, target, percent, least, longest=1, size=resampling.BUCKETS):
    def found(text):
        words = WORD.findall((text or "").translate(LOWER))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return [zlib.crc32(r.encode()) % size for r in runs]

    held = [found(t) for _, t in docs]
    s, t = Counter(sum(held, [])), Counter(sum((found(x) for x in target), []))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + size) / ((s[b] + 1) * (T + size)))) for b in range(size)]
    rows = []
    for (doc_id, _), f in zip(docs, held):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted(map(str, rows))


def listed(df):
    return sorted(str([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]]) for r in df.collect())


def test_odd_rows(spark):
    target = ["One line here, the same number.", None, "", "Überall ist Weißraum"]
    bench = spark.createDataFrame([(t, 0) for t in target], "text string, bucket int")
    docs = [(r[0], r[1]) for r in TEXTS]
    for longest in (1, 3):
        got = resampling.resample(documents(spark), bench, 60, 1, longest=longest)
        assert listed(got) == plain(docs, target, 60, 1, longest)
    assert resampling.resample(documents(spark).limit(0), bench).collect() == []
    assert listed(resampling.resample(documents(spark), bench.limit(0), 60, 1)) == plain(docs, [], 60, 1)
    assert listed(resampling.resample(documents(spark), bench, 10, 20)) == plain(docs, target, 10, 20)


def test_ranks_over_many_runs_and_ties(spark):
    """Few different scores, repeated ids, a third of all rows equal: ranks are those of a plain sort."""
    rng = random.Random(8)
    rows = [(rng.randint(-3, 3), rng.choice([None, *range(50)])) for _ in range(4000)] + [(2, 7)] * 2000
    table = spark.createDataFrame(rows, "score long, doc_id long").repartition(13).withColumn("row", F.monotonically_increasing_id())
    table = spark.createDataFrame(table.collect(), table.schema).repartition(7)
    for take, segments in ((600, 40), (1, 5), (6000, 17), (5999, None), (0, None)):
        out = resampling.ranked(table, take, segments).collect()
        assert len(out) == 6000
        drawn = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in drawn] == list(range(1, take + 1))
        want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:take]
        assert [(r["score"], r["doc_id"]) for r in drawn] == want


def test_splitters_part_evenly(spark):
    table = spark.range(0, 50_000, 1, 6).select(
        F.xxhash64("id").alias("score"), F.col("id").alias("doc_id"), F.col("id").alias("row")
    )
    split = resampling.splitters(table, 20)
    assert len(split) == 19 and split == sorted(split)
    scores = sorted(-r["score"] for r in table.collect())
    sizes = [b - a for a, b in zip([0, *(sum(s < k[0] for s in scores) for k in split)], [*(sum(s < k[0] for s in scores) for k in split), 50_000])]
    assert max(sizes) < 2 * 50_000 / 20
