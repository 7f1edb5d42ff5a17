import math
import random

import numpy as np

from tessera.llm import op4
from tessera.llm.multi_index import MultiIndex, near_duplicates

SF = "/root/testdata/sf0.01"


def brute(rows, least=0.93):
    good = {i: np.array(v, float) for i, l, v in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    label = {i: l for i, l, v in rows if i in good}
    ids = sorted(good)
    parent, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if label[a] == label[b] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= least:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (links[i], find(i)) for i in parent}


def check(rows, got):
    want = brute(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_all_vectors(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, op4.op4_near_vectors(spark, SF).collect())


def test_hot_group_and_odd_rows(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=16)
    rows = [(i, 1, (base + 0.05 * r.normal(size=16)).tolist()) for i in range(400)]
    rows += [(1000 + i, int(i % 3), r.normal(size=16).tolist()) for i in range(60)]
    rows += [(2000, None, base.tolist()), (2001, 1, None), (2002, 1, [0.0] * 16), (2003, 1, [float("nan")] * 16), (2004, 1, [None] + [1.0] * 15), (2005, 1, []), (2006, 1, base[:8].tolist()), (2007, 1, base[:8].tolist()), (2008, 1, [math.inf] * 16), (2009, 2, base.tolist())]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, label int, embedding array<double>").selectExpr("*", "1 as cell", "'x' as unit")
    check(rows, near_duplicates(df).collect())
    assert near_duplicates(df.limit(0)).count() == 0


def test_traversal_order():
    r = random.Random(1)
    index = MultiIndex(np.zeros((5, 1)), np.zeros((4, 1)), 3)
    a, b = np.array([r.random() for _ in range(5)]), np.array([r.random() for _ in range(4)])
    want = sorted(range(20), key=lambda c: a[c // 4] + b[c % 4])
    assert index.nearest(a, b, 20) == want and index.nearest(a, b, 3) == want[:3]
