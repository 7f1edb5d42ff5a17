import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import ngram_join, op10
from tessera.llm.ngram_join import ngram_groups
from tessera.llm.shingles import id_filter, maybe_in, shingle_sets

SF = "/root/testdata/sf0.01"


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])


def brute(docs, n, num, den):
    sets = [shingles(t, n) for _, t in docs]
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    shared = defaultdict(int)
    for x in by.values():
        for p in range(len(x)):
            for q in range(p + 1, len(x)):
                shared[x[p], x[q]] += 1
    for (p, q), c in shared.items():
        if c * den >= num * (len(sets[p]) + len(sets[q]) - c):
            a, b = sorted((find(docs[p][0]), find(docs[q][0])))
            parent[b] = a
    return sorted((i, len(s), find(i)) for (i, _), s in zip(docs, sets))


def rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(op10.op10_ngram_join(spark, SF)) == brute(docs, 3, 90, 100)
    assert rows(ngram_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs, 5, 80, 100)


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_hot_groups_and_odd_texts(spark, n, num, den, monkeypatch):
    monkeypatch.setattr(ngram_join, "LISTED", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 8)
    r = random.Random(n)
    base = [f"w{r.randint(0, 400)}" for _ in range(60)]

    def near():
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
        return " ".join(w)

    texts = [near() for _ in range(60)] + [" ".join(f"w{r.randint(0, 400)}" for _ in range(r.randint(0, 40))) for _ in range(40)]
    texts += ["", None, " \t\n", "one", "ONE", "one two", "One\x0btwo", "É é", "é é", "a\x1cb", "a b", "same same same same same same", "long " * 30_000 + "end", "long " * 30_000] + [texts[0]] * 7
    r.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as cid", "2 as token")
    assert rows(ngram_groups(df, n, num, den, bits=16)) == brute(docs, n, num, den)


def test_empty_single_and_repeats(spark):
    df = spark.createDataFrame([(4, "a b c d e f")] * 2 + [(9, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert rows(ngram_groups(df, 3, 90, 100, bits=16)) == [(2, 0, 2), (4, 4, 4), (4, 4, 4), (9, 4, 4)]
    assert ngram_groups(df.limit(0), bits=16).count() == 0


def test_one_id_in_several_texts(spark):
    x, y, z = "a b c d e f", "g h i j k l", "m n o p"
    df = spark.createDataFrame([(3, x), (5, x), (5, y), (9, y), (7, z), (5, ""), (None, y), (None, x)], "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_groups(df, 3, 90, 100, bits=16).collect()]
    assert sorted(got, key=str) == sorted([(3, 4, 3), (5, 4, 3), (5, 4, 3), (9, 4, 3), (7, 2, 7), (5, 0, 5), (None, 4, None), (None, 4, None)], key=str)


def test_shingle_sets_and_filter(spark):
    for n in (1, 3, 5):
        texts = ["a b c a b c", "a B c", "x", "", None, "a b c d"]
        assert [len(s) for s in shingle_sets(texts, n)] == [len(shingles(t, n)) for t in texts]
    ids = spark.createDataFrame([(i * 7,) for i in range(1000)], "cid long")
    packed = id_filter(ids, 20)
    assert maybe_in(np.arange(0, 7000, 7), packed).all() and maybe_in(np.arange(10**6, 10**6 + 10**4), packed).mean() < 0.01


def test_unlike_texts_of_hot_shingles_form_no_large_cluster(spark, monkeypatch):
    """Each hot shingle is in a few texts of each of many sizes; together they reach all texts."""
    monkeypatch.setattr(ngram_join, "LISTED", 4)
    seen, deal = [], ngram_join._block_links
    monkeypatch.setattr(ngram_join, "_block_links", lambda members, *rest: seen.append(members.groupBy("cluster").count().collect()) or deal(members, *rest))
    r = random.Random(4)
    docs = []
    for i in range(160):
        docs.append((i, " ".join(f"hot{k}" for k in r.sample(range(1500), int(20 * 1.25 ** (i // 10))))))
    docs += [(1000 + i, docs[120][1] + f" end{i}") for i in range(12)]
    assert rows(ngram_groups(spark.createDataFrame(docs, "doc_id long, text string"), n=1, num=80, den=100)) == brute(docs, 1, 80, 100)
    sizes = [x["count"] for x in seen[0]]
    assert 12 < max(sizes) < 60
