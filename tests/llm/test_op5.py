import math

import numpy as np
import pytest

from tessera.llm import mtree, op5
from tessera.llm.mtree import MTree, build, top_k

SF = "/root/testdata/sf0.01"


def brute(rows, k=10):
    good = {}
    for i, v in sorted(((i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)), key=lambda x: (x[0], x[1])):
        good.setdefault(i, [math.floor(1024 * x) for x in v])
    out = []
    for q in good:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_all_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op5.op5_top_k(spark, SF).collect())) == brute(rows)


def test_ties_and_odd_rows(spark):
    rows = [(i, [1.0, 0.5, -0.25]) for i in range(300)] + [(1000, [3.0, 1e6, 2.0]), (1001, None), (1002, [float("nan"), 1.0, 1.0]), (1100, [0.0] * 3), (1200, []), (1003, [None, 1.0, 1.0])]
    df = spark.createDataFrame(rows + rows[:4], "vec_id long, embedding array<double>").selectExpr("*", "1 as shard", "2 as v")
    got = top_k(df, df.filter("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert top_k(df.limit(0), df).count() == 0 and top_k(df, df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, top_k(few, few.filter("vec_id = 0")).collect())) == [(0, 1, 1, 2048 * 1024)]


def test_lengths_and_large_integers(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=2 + i % 3).tolist()) for i in range(400)] + [(1000, [1e9, 2.5e9, 1.0]), (1001, [-3e5, 1.0, 2.0]), (1100, [1e3, 1e3, -1e3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by_width = [brute([x for x in rows if len(x[1]) == w]) for w in (2, 3, 4)]
    assert sorted(map(tuple, top_k(df, df.filter("vec_id % 100 = 0 and vec_id <> 1000")).collect())) == sorted(x for b in by_width for x in b if x[0] != 1000)
    for bad in ([[1e12, 1e12], [2e12, 1.0]], [[1e17, 1.0], [1.0, 1.0]]):
        huge = spark.createDataFrame(list(enumerate(bad)), "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond a long"):
            top_k(huge, huge).collect()


def test_shards_by_pivots(spark, monkeypatch):
    monkeypatch.setattr(mtree, "SHARD", 200)
    monkeypatch.setattr(mtree, "BLOCK", 7)
    r = np.random.default_rng(4)
    centers = r.normal(size=(12, 6)) * 4
    rows = [(i, (centers[i % 12] + r.normal(size=6) * 0.2).tolist()) for i in range(3000)] + [(i, centers[0].tolist()) for i in range(3000, 4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(df, df.filter("vec_id % 100 = 0")).collect())) == brute(rows)
    # a query that is in no shard of its own finds all the same
    other = spark.createDataFrame([(7_000_000, [50.0] * 6), (1, [0.0] * 6)], "vec_id long, embedding array<double>")
    got = top_k(df, other).collect()
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows}
    for q, v in ((7_000_000, [51200] * 6), (1, [0] * 6)):
        want = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole.items() if i != q)[:10]
        assert sorted((-x.score, x.vec_id) for x in got if x.query_id == q) == sorted(want)


def test_tree_skips_distances():
    r = np.random.default_rng(1)
    rows = (r.normal(size=(40, 1, 3)) * 1000 + r.normal(size=(40, 50, 3)) * 10).reshape(-1, 3).astype(np.int64)
    tree = MTree(build(np.arange(2000), rows, 0, leaf=64))
    for q in range(0, 2000, 97):
        want = sorted(((int(-(rows[q] @ rows[i])), i) for i in range(2000) if i != q))[:10]
        assert [(-s, i) for s, i in tree.search(q, rows[q], 10)] == want
    assert tree.computed < 21 * 1200
