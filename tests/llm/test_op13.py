import hashlib
import random

import numpy as np
import pytest

from tessera.llm import repeats, suffixes
from tessera.llm.op13 import op13_suffix_dedup
from tessera.llm.repeats import remove_repeats

SF = "/root/testdata/sf0.01"


def brute(docs):
    """docs of (doc_id, text) with ids that don't repeat."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is not None, d[0])):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, np.int64)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p] += 1
                gone[min(p + 100, len(raw))] -= 1
            else:
                seen.add(w)
        gone = np.cumsum(gone)[: len(raw)] > 0
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert rows(op13_suffix_dedup(spark, SF)) == want
    assert sum(r[2] for r in want) > 100_000


def made(r, n):
    """Texts of pieces that repeat with other pieces on both sides, cut anywhere."""
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 9)))
    stock = [" ".join(word() for _ in range(r.randint(10, 60))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 6)):
            s = r.choice(stock)
            a = r.randint(0, len(s) // 2)
            parts += [s[a : r.randint(a, len(s))], word() * r.randint(0, 3)]
        texts.append(r.choice(["", "x"]) + "".join(parts))
    return texts


@pytest.mark.parametrize("most, piece", [(1 << 15, 1 << 18), (3, 1 << 18), (1 << 15, 256)])
def test_cut_pieces(spark, monkeypatch, most, piece):
    monkeypatch.setattr(repeats, "MOST", most)
    monkeypatch.setattr(repeats, "HOT", most)
    monkeypatch.setattr(suffixes, "PIECE", piece)
    monkeypatch.setattr(suffixes, "_POWERS", [])
    r = random.Random(most + piece)
    docs = [(i * 3 - 50, t) for i, t in enumerate(made(r, 150))]
    docs += [(9000, None), (9001, ""), (9002, "a" * 99), (9003, "a" * 100), (9004, "a" * 1000), (9005, "ab" * 5000), (9006, "x" + "ab" * 300), (9007, "\0" * 150 + "q" * 10), (9008, "z" + "\0" * 130), (None, "ab" * 60)]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).selectExpr("*", "1 as key", "2 as at", "3 as doc", "4 as sub", "5 as copy")
    assert rows(remove_repeats(df)) == brute(docs)


def test_hot_passage_with_many_neighbours(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 200)
    r = random.Random(8)
    passage = " ".join(str(r.random()) for _ in range(12))
    docs = [(i, f"{r.random()} {r.random()} {passage} {r.random()} {i * 7919}") for i in range(1500)]
    docs += [(2000 + i, docs[3][1]) for i in range(400)]
    assert rows(remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_rows_that_repeat_an_id(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh") for _ in range(400))
    df = spark.createDataFrame([(1, long), (1, long), (2, long), (None, long[:150]), (None, long[:150]), (None, None), (3, "short"), (3, "short")], "doc_id long, text string")
    got = rows(remove_repeats(df))
    empty = hashlib.sha256(b"").hexdigest()
    first = (None, 150, 0, 0, hashlib.sha256(long[:150].encode()).hexdigest())
    rest = (1, 400, 150, 1, hashlib.sha256(long[150:].encode()).hexdigest())
    short = (3, 5, 0, 0, hashlib.sha256(b"short").hexdigest())
    want = [first, (None, 150, 150, 1, empty), (None, 0, 0, 0, empty), rest, (1, 400, 400, 1, empty), (2, 400, 400, 1, empty), short, short]
    assert got == sorted(want, key=repr)


def test_empty_table(spark):
    assert rows(remove_repeats(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_anchors_are_few_and_depend_on_content_only():
    r = np.random.default_rng(3)
    text = r.integers(97, 123, 60_000, np.uint8).tobytes()
    _, key, ctx, at = suffixes.samples([b"q" * 77 + text, text[:50_000]])
    lo, n, off = suffixes.unpacked(at)
    assert len(at) < 0.045 * 110_000 and n.max() <= suffixes.WINDOWS and (off < suffixes.WINDOWS).all()
    # all windows once, and the anchors of the second text are those of the first, but at its ends
    assert n.sum() == 60_077 - 99 + 50_000 - 99
    first = {(k, c) for k, c, p in zip(key.tolist(), ctx.tolist(), range(len(at))) if p < np.argmax(lo[1:] < lo[:-1]) + 1}
    second = [(k, c) for k, c, p in zip(key.tolist(), ctx.tolist(), range(len(at))) if p > np.argmax(lo[1:] < lo[:-1])]
    assert sum(x not in first for x in second) <= 3
