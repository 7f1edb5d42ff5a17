import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import op6
from tessera.llm.mixing import features, mix, quality, repeated

SF = "/root/testdata/sf0.01"


def brute_targets(sizes):
    names = sorted((k for k in sizes if k is not None), key=lambda k: [ord(c) for c in k]) + [None] * (None in sizes)
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(2 * sizes[k] for k in full)
        free = [k for k in names if k not in full]
        target = {k: 2.0 * sizes[k] for k in full} | {k: rest * weight[k] / sum(weight[x] for x in free) for k in free}
        over = [k for k in free if target[k] > 2 * sizes[k]]
        if not over:
            return target
        full |= set(over)


def check(docs, got):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    sizes, took = defaultdict(int), defaultdict(int)
    for i, _, s in docs:
        sizes[s] += size[i]
    target = brute_targets(sizes)
    source = {i: s for i, _, s in docs}
    assert len(got) == len(docs)
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and r.taken <= 2 * r.size and r.taken == r.size * r.copies
        assert math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-6)
        took[s] += r.taken
    for s in sizes:
        longest = max(size[i] for i, _, x in docs if x == s)
        assert abs(took[s] - target[s]) <= longest / 2 + 1e-6, s


def test_all_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    got = op6.op6_mix_sources(spark, SF).collect()
    check([tuple(r) for r in rows], got)
    again = op6.op6_mix_sources(spark, SF).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_small_tables(spark):
    r = random.Random(5)
    for n in (1, 2, 30, 300):
        docs = [(i, None if r.random() < 0.1 else " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 60))), r.choice(["b", "a", None, "é", "\U00010000", "￰", "hot", "hot", "hot"])) for i in range(n)]
        df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"size": F.lit("x"), "key": F.lit(1), "extra": F.lit(2), "bucket": F.lit(3), "cut": F.lit(4), "epochs": F.lit(5), "row": F.lit(6), "level": F.lit(7), "c": F.lit(8)})
        got = mix(df).collect()
        check(docs, got)
        times = {r.doc_id: r.copies for r in got}
        rows = repeated(df).collect()
        assert sorted(r.doc_id for r in rows) == sorted(i for i, k in times.items() for _ in range(k)) and all((r.extra, r.bucket, r.cut, r.epochs, r.row, r.level, r.c) == (2, 3, 4, 5, 6, 7, 8) for r in rows)
    assert mix(df.limit(0)).count() == 0


def test_ties_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b c", "x")] * 6 + [(None, "a b", "x"), (2, "long " * 200_000, "y")], "doc_id long, text string, source string")
    got = mix(df).collect()
    assert len(got) == 8 and all(r.taken <= 2 * r.size for r in got) and sum(r.size for r in got) == 200_020


def test_selection_matches_sorted_keys(spark):
    r = random.Random(8)
    docs = [(i, "w. " * r.randint(0, 30) + "***" * (i % 2), r.choice(["a", "b", "hot", "hot"])) for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in mix(df, df.selectExpr("doc_id", "doc_id % 2 as quality")).collect()}
    assert got[1].key != mix(df).filter("doc_id = 1").first().key
    sizes = {s: sum(x.size for x in got.values() if x.source == s) for s in ("a", "b", "hot")}
    for s, aim in brute_targets(sizes).items():
        epochs = int(aim // sizes[s])
        rest, at = aim - epochs * sizes[s], 0
        for x in sorted((x for x in got.values() if x.source == s), key=lambda x: (x.key, str(x.doc_id), x.size)):
            # what begins within the rest is in while its middle is
            assert x.copies == epochs + (at + x.size / 2 <= rest and at < rest), (s, x)
            at += x.size


def test_quality_follows_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    binned = docs.select("doc_id", features(F.col("text")).alias("bins"))
    weight = quality(binned, labels)
    rows = binned.join(labels, "doc_id").select("quality", weight(F.col("bins")).alias("w")).collect()
    good, bad = [x.w for x in rows if x.quality == 1], [x.w for x in rows if x.quality == 0]
    above = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert above > 0.9 and all(0.05 <= x.w <= 1 for x in rows)
    for none in (labels.filter("quality = 1"), labels.limit(0)):
        assert {x[0] for x in binned.select(quality(binned, none)(F.col("bins"))).collect()} == {1.0}
