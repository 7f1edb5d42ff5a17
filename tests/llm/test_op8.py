import base64
from collections import defaultdict

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import op8
from tessera.llm.rollups import Rollup, byte_counts, deletes, inserts, revisions, word_counts
from tessera.runtime import new_path

SF = "/root/testdata/sf0.01"


def test_all_documents_match_brute_force(spark):
    tok = Tokenizer.from_file(op8.WORDS)
    with open(op8.BYTES, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "text").collect())
    want, seen = defaultdict(lambda: [0, 0]), set()
    for r in rows:
        text = r.text or ""
        pairs = [("word_bpe_49k", len(tok.encode(text, add_special_tokens=False).ids) + 1)]
        if text not in seen:
            pairs.append(("byte_bpe_50k", len(enc.encode_ordinary(text))))
        seen.add(text)
        for version, n in pairs:
            want[r.source, r.lang, version][0] += 1
            want[r.source, r.lang, version][1] += n
    got = {tuple(r[:3]): list(r[3:]) for r in op8.op8_token_rollup(spark, SF).collect()}
    assert got == dict(want)


def test_compaction(spark):
    rollup = Rollup(spark, new_path(spark, "test"))
    docs = spark.createDataFrame([("a", "en", 5), ("b", None, 7)], "source string, lang string, n long")
    rollup.compact()
    for name in ("a/b=c", "x y", "é%"):
        assert rollup.commit(name, inserts(docs, "v", F.col("n")))
    before = sorted(map(tuple, rollup.totals().collect()), key=str)
    rollup.compact()
    rollup.compact()
    assert rollup.batches() == sorted(["a/b=c", "x y", "é%"]) and sorted(map(tuple, rollup.totals().collect()), key=str) == before
    assert not rollup.commit("x y", inserts(docs, "v", F.col("n"))) and rollup.commit("more", deletes(docs, "v", F.col("n")))
    # a base without its mark doesn't count, and is written anew
    docs.selectExpr("source", "lang", "'v' as version", "9L as n_docs", "9L as n_tokens").write.parquet(f"{rollup.path}/base=2/totals")
    rollup.compact()
    assert sorted((r.source, r.n_docs, r.n_tokens) for r in rollup.totals().collect()) == [("a", 2, 10), ("b", 2, 14)] and len(rollup.batches()) == 4


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "The <|endoftext|> é" * 3000)], "doc_id long, text string")
    got = {r.doc_id: r.n for r in word_counts(docs, op8.WORDS, "n").collect()}
    assert got == {1: 0, 2: 0, 3: len(Tokenizer.from_file(op8.WORDS).encode("The <|endoftext|> é" * 3000, add_special_tokens=False).ids)}
    assert [r.n for r in byte_counts(docs.filter("doc_id < 3"), op8.BYTES, public_tokenizers.PATTERN, "n").collect()] == [0, 0]


def test_batches_are_committed_once(spark):
    rollup = Rollup(spark, new_path(spark, "test"))
    assert rollup.totals().count() == 0 and rollup.batches() == []
    docs = spark.createDataFrame([("a", "en", 5), ("a", "en", 5), ("a", None, 7), (None, "de", None)], "source string, lang string, n long").selectExpr("*", "1 as version", "'x' as tokens")
    n = F.col("n")
    assert rollup.commit("1", inserts(docs, "v", n)) and not rollup.commit("1", inserts(docs, "v", n))
    key = lambda: sorted(((r.source, r.lang, r.n_docs, r.n_tokens) for r in rollup.totals().collect()), key=str)
    assert key() == sorted([("a", "en", 2, 10), ("a", None, 1, 7), (None, "de", 1, 0)], key=str)
    # a batch without its mark of success doesn't count and can be written again
    inserts(docs, "v", n).selectExpr("source", "lang", "version", "9L as n_docs", "9L as n_tokens").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{rollup.path}/batch=2")
    assert rollup.batches() == ["1"]
    assert rollup.commit("2", revisions(docs.filter("lang = 'en'"), "v", n, n + 1)) and rollup.commit("3", deletes(docs.filter("lang is null"), "v", n))
    assert rollup.commit("4", inserts(docs.limit(0), "v", n))
    assert key() == sorted([("a", "en", 2, 12), (None, "de", 1, 0)], key=str)
