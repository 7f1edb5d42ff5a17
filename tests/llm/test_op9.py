import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tessera.llm import op9
from tessera.llm.repair import Shard, compress
from tessera.llm.token_files import read_shards, write_shards
from tessera.llm.tokenizer import WordEncoder
from tessera.runtime import new_path

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, got):
    tok, at, want = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(docs, key=lambda x: (x[0] is not None, x[0], x[1] is not None, x[1])):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == [(b, a, c, d) for a, b, c, d in want]


def test_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, op9.op9_token_files(spark, SF).collect())


def test_small_tables(spark):
    r = random.Random(4)
    docs = [(None if i == 3 else r.randint(0, 30), r.choice([None, "", "the of and " * r.randint(1, 3000), "日本 x", "a b"])) for i in range(60)]
    for rows in (docs, [(5, None)], []):
        path = new_path(spark, "test")
        write_shards(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as data"), PATH, path, shard_tokens=2000)
        check(rows, read_shards(spark, path).collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=80), min_size=1, max_size=12))
def test_round_trip_and_random_access(docs):
    lens = np.array([len(d) for d in docs])
    shard = Shard(compress(np.concatenate([np.array(d) for d in docs]).astype(np.uint32), lens, 100, rules_per_round=3, least=2))
    assert shard.all().tolist() == [x for d in docs for x in d]
    for i, d in enumerate(docs):
        assert shard.document(i).tolist() == d and shard.token(i, len(d) // 2) == d[len(d) // 2]


def test_frequent_pairs_shrink():
    ids = np.tile(np.array([5, 6, 7, 8], np.uint32), 1000)
    shard = Shard(compress(ids, np.array([4000]), 100))
    assert len(shard.symbols) < 600 and shard.all().tolist() == ids.tolist()


def left_over(shard):
    """The most occurrences that a pair of neighbours within a document has."""
    a, inner = shard.symbols, np.ones(len(shard.symbols), bool)
    inner[shard.ends - 1] = False
    at = np.flatnonzero(inner)
    return max(Counter(zip(a[at].tolist(), a[at + 1].tolist())).values(), default=0)


def test_no_frequent_pair_is_left():
    r = np.random.default_rng(5)
    phrases = [r.zipf(1.3, r.integers(2, 40)) % 5000 for _ in range(3000)]
    docs = [np.concatenate([phrases[i] for i in r.integers(0, 3000, 20)] + [[7] * int(r.integers(1, 30))]) for _ in range(400)]
    lens = np.array([len(d) for d in docs])
    for ids, n, least in ((np.concatenate(docs), lens, 8), (np.concatenate(docs[:40]), lens[:40], 2), (np.zeros(9000), np.array([1, 8000, 999]), 8), (np.arange(9000) % 3, np.array([9000]), 2)):
        shard = Shard(compress(ids.astype(np.uint32), n, 1 << 16, least=least))
        assert left_over(shard) < least and shard.all().tolist() == ids.tolist()
        for i in (0, len(n) - 1):
            assert len(shard.document(i)) == n[i] and shard.token(i, int(n[i]) - 1) == ids[int(n[: i + 1].sum()) - 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=1, max_size=60), min_size=1, max_size=8), st.integers(1, 4), st.integers(2, 4))
def test_none_left_in_few_rules_a_round(docs, rules, least):
    ids, lens = np.concatenate([np.array(d) for d in docs]).astype(np.uint32), np.array([len(d) for d in docs])
    shard = Shard(compress(ids, lens, 100, rules_per_round=rules, least=least))
    assert left_over(shard) < least and shard.all().tolist() == ids.tolist()


def test_shards_of_documents_are_small(spark):
    enc = WordEncoder(PATH)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").collect()]
    ids, lens = enc.encode_with_end(texts)
    data = compress(ids, lens, enc.size)
    shard = Shard(data)
    assert (shard.all() == ids).all() and left_over(shard) < 8
    # under nine tenths of two bytes an id, rules, lengths and ends included
    assert len(data) < 0.9 * 2 * len(ids)
    wide = compress(ids, lens, 1 << 16)
    assert (Shard(wide).all() == ids).all() and len(wide) > 1.8 * len(data)
