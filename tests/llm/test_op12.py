import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import spelling
from tessera.llm.op12 import op12_spelling_variants
from tessera.llm.spelling import spelling_groups
from tessera.llm.wavelet import WaveletTree

SF = "/root/testdata/sf0.01"


def brute(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    gaps, near = defaultdict(set), defaultdict(set)
    for w in words:  # words meet on what is left after one deletion, or by one of them being that
        for i in range(len(w)):
            gaps[w[:i] + "*" + w[i + 1 :]].add(w)
            if (less := w[:i] + w[i + 1 :]) in words:
                near[w].add(less)
                near[less].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 2 * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def test_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert rows(op12_spelling_variants(spark, SF)) == want
    assert sum(r[4] for r in want) > 1000 and any(r[1] and r[2] != r[1] for r in want)


@pytest.mark.parametrize("shard_words", [7, 20_000])
def test_odd_texts_many_shards_and_clashing_names(spark, monkeypatch, shard_words):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard_words)
    r = random.Random(5)
    docs = [(r.choice([None, i]), r.choice([None, "", "Zebra zebra zebrä zebras zebrra zzebra", "ÿÿÿÿÿ ÿÿÿÿÿÿ ×÷×÷×", "日本houseĀhouses", " ".join("".join(r.choice("abB") for _ in range(r.randint(4, 8))) for _ in range(300))])) for i in range(60)]
    docs += [(i, ("long" * 3000 + x) * 1) for i in range(3) for x in ("", "a", "b")] + [(7, "twice twice again")] * 2
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as part", "4 as root")
    assert rows(spelling_groups(df)) == brute(docs)


def test_no_words(spark):
    for docs in ([], [(1, None)], [(1, "ab cd ab cd")], [(1, "alone alone alone")]):
        assert rows(spelling_groups(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_wavelet_reports_each_point_of_a_rectangle():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 300):
        values = r.permutation(n)
        a, b, lo, hi = (r.integers(0, n + 1, 200) for _ in range(4))
        q, v = WaveletTree(values).report(a, b, lo, hi)
        got = sorted(zip(q.tolist(), v.tolist()))
        assert got == sorted((k, int(x)) for k in range(200) for x in values[a[k] : b[k]] if lo[k] <= x < hi[k])
