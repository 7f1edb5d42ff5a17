from collections import Counter

import corpus_pipeline as cp
from pyspark.sql import functions as F
from tests.llm import test_op2, test_op6, test_op7, test_op10

SF = "/root/testdata/sf0.001"


def stage(spark, name, docs):
    return dict(cp.STAGES)[name](spark, docs, SF)


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = stage(spark, "language", docs).cache()
    assert kept.columns == docs.columns and kept.count() >= 0.98 * len(texts)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    single = stage(spark, "near_duplicates", kept).cache()
    want = {i for i, _, c in test_op10.brute(rows, 5, 80, 100) if i == c}
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns
    masked = stage(spark, "personal_data", single).cache()
    assert masked.columns == docs.columns and masked.dtypes == docs.dtypes
    for r in masked.collect():
        base = test_op2.brute(texts[r.doc_id])
        assert not [s for s in test_op2.brute(r.text) if s[0] != "phone"] and (base or r.text == texts[r.doc_id]) and r.n_chars == len(r.text)
    mixed = stage(spark, "mixture", masked).cache()
    rows = [(r.doc_id, r.text, r.source) for r in masked.collect()]
    took, target = Counter(), test_op6.brute_targets({s: sum(len((t or "").split()) for _, t, x in rows if x == s) for _, _, s in rows})
    for r in mixed.collect():
        took[r.source] += len((r.text or "").split())
    for s, aim in target.items():
        assert abs(took[s] - aim) <= max(len((t or "").split()) for _, t, x in rows if x == s) / 2 + 1
    pieces = stage(spark, "packing", mixed).collect()
    total = Counter(r.doc_id for r in mixed.collect())
    once = {r.doc_id: r for r in pieces if r.start == 0}
    assert Counter(r.doc_id for r in pieces if r.start == 0) == total
    assert sum(r.length for r in pieces) == sum(once[i].doc_tokens * n for i, n in total.items())


def test_run_gives_whole_sequences(spark):
    got = cp.run(spark, SF).collect()
    sizes = Counter()
    for r in got:
        sizes[r.sequence_id] += r.length
    assert sorted(sizes) == list(range(len(sizes))) and all(n & (n - 1) == 0 and n <= 4096 for n in sizes.values())


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in cp.STAGES:
        assert f(spark, docs, SF).count() == 0


NAMES = ["bucket", "cut", "epochs", "score", "rejected", "lang_pred", "verdict", "found", "_found", "_h", "row", "copy", "component_id", "level", "d", "text_hash", "queue"]


def test_stages_on_odd_rows_and_clashing_names(spark):
    plain = "the and of with this is to be it by one more word here and there"
    texts = [(1, plain), (2, plain), (None, plain), (None, None), (3, None), (4, ""), (5, "12 34"), (6, "mail a@b.co now the and of with this"), (6, "the and of with this mail c@d.org then"), (7, "the and of " * 60_000), (8, plain + " x"), (8, "quite another text of the same id with the and of words")]
    rows = [(i, t, "en", None if i == 4 else "s", len(t or "")) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"{k} + 0.5 as `{n}`" for k, n in enumerate(NAMES)])
    same = lambda df: all(tuple(r[n] for n in NAMES) == tuple(k + type(r[NAMES[0]])("0.5") for k in range(len(NAMES))) for r in df.collect())
    out = {}
    for name, stage_ in cp.STAGES[:-1]:
        out[name] = stage_(spark, docs, SF)
        assert out[name].columns == docs.columns and out[name].dtypes == docs.dtypes and same(out[name]), name
    found = {k: Counter(r.doc_id for r in df.collect()) for k, df in out.items()}
    # texts without letters go
    assert found["language"] == Counter({1: 1, 2: 1, None: 1, 6: 2, 7: 1, 8: 2})
    # 2 and the first text of 8 are near copies of 1, so both rows of 8 go; rows without an id stay
    assert found["near_duplicates"] == Counter({1: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 2, 7: 1})
    assert found["personal_data"] == Counter(i for i, _ in texts)
    masked = {(r.doc_id, r.text): r.n_chars for r in out["personal_data"].collect()}
    for text in ("mail [EMAIL] now the and of with this", "the and of with this mail [EMAIL] then"):
        assert masked[6, text] == len(text)
    assert masked[None, None] == 0
    assert set(found["mixture"]) <= {i for i, _ in texts} and all(n >= 1 for n in found["mixture"].values())
    pieces = cp.packing(spark, docs, SF).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(i for i, _ in texts)


def test_texts_of_an_unlearned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    unlearned = docs.withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    kept = stage(spark, "language", unlearned)
    assert kept.filter("lang is null").count() < 0.15 * docs.filter("lang = 'de'").count()
    assert kept.filter("lang is not null").count() > 0.97 * docs.filter("lang <> 'de'").count()
