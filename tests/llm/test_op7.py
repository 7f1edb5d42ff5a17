import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import op7
from tessera.llm.packing import Schedule, pack
from tessera.llm.tokenizer import WordEncoder

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, got):
    tok = Tokenizer.from_file(PATH)
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t, _ in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == len(ids[i])
    pad = 0
    for parts in by_seq.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        size = sum(n for _, n in parts)
        assert size <= 4096
        pad += 0 if size & (size - 1) == 0 else 4096 - size
    assert pad == 0 and sorted(by_seq) == list(range(len(by_seq)))
    return by_seq


def test_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = op7.op7_pack(spark, SF).collect()
    check(rows, got)
    source, total = {i: s for i, _, s in rows}, defaultdict(int)
    windows = defaultdict(lambda: defaultdict(int))
    for r in got:
        total[source[r.doc_id]] += r.length
        windows[r.sequence_id][source[r.doc_id]] += r.length
    every = sum(total.values())
    for seq in list(windows)[: every // 4096]:
        if sum(windows[seq].values()) == 4096:
            assert all(abs(windows[seq][s] - 4096 * total[s] / every) <= 2 * len(total) + 2 for s in total)


def test_small_tables(spark):
    r = random.Random(7)
    for n in (1, 2, 40):
        docs = [(i, None if r.random() < 0.1 else " ".join(r.choice(["the", "Ödland", "x1", "<|endoftext|>", "日本"]) for _ in range(r.choice([0, 3, 50, 9000]))), r.choice(["a", "b", None, "n", "rare"])) for i in range(n)]
        check(docs, pack(spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as ids", "2 as part"), PATH).collect())
    assert pack(spark.createDataFrame([], "doc_id long, text string, source string"), PATH).count() == 0


def test_schedule_covers_every_place():
    r = random.Random(2)
    for _ in range(50):
        totals = [r.randint(1, r.choice([3, 100, 20000])) for _ in range(r.randint(1, 30))]
        weights = r.choice([None, [r.choice([0, 0.1, 1, 3]) for _ in totals]])
        s = Schedule(totals, 64, weights)
        q = np.repeat(np.arange(len(totals)), [2 if t > 1 else 1 for t in totals])
        n = np.array([x for t in totals for x in ([t // 2, t - t // 2] if t > 1 else [t])])
        start = np.array([x for t in totals for x in ([0, t // 2] if t > 1 else [0])])
        row, rel, size, seq, off = s.pieces(q, start, n)
        base = {int(k): 64 * int(k) if k < s.full else int(s.tail[k - s.full]) for k in np.unique(seq)}
        covered = sorted((base[int(a)] + int(b), int(c)) for a, b, c in zip(seq, off, size))
        at = 0
        for place, k in covered:
            assert place == at
            at += k
        assert at == sum(totals)
        # every slice of a phase serves each queue its part of 64 ids, to one id
        for p in s.phases:
            of = np.arange(len(totals))
            for w in range(min(p.slices, 5)):
                got = p.served(np.full(len(of), w + 1), of) - p.served(np.full(len(of), w), of)
                assert all(abs(g - t / p.slices) < 1 for g, t in zip(got.tolist(), p.totals))


def test_target_weights(spark):
    docs = [(i, "the of and " * 400, "ab"[i % 2]) for i in range(60)] + [(100, "the " * 50, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    got = pack(df, PATH, weights={"a": 3, "b": 1}).collect()
    seqs = check(docs, got)
    source = {i: s for i, _, s in docs}
    took = defaultdict(lambda: defaultdict(int))
    for r in got:
        took[r.sequence_id][source[r.doc_id]] += r.length
    # a ends first, after 36,030 * 4 / 3 ids; then b alone, and last what has no weight
    # the twelve slices of the first phase are that much shorter than a window
    for seq in range(36_030 * 4 // 3 // 4096 - 1):
        assert abs(took[seq]["a"] - 3072) <= 4096 / 12 + 2 and abs(took[seq]["b"] - 1024) <= 4096 / 12 + 2
    assert took[max(seqs)][None] > 0 and sum(x[None] for x in took.values()) == 51


def test_more_sources_than_a_window_has_ids(spark):
    docs = [(i, "x", f"s{i}") for i in range(6000)] + [(9000 + i, "the of and " * 2000, "big") for i in range(8)]
    got = pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), PATH).collect()
    check(docs, got)
    share = 8 * 6001 / (8 * 6001 + 12000)
    took = defaultdict(int)
    for r in got:
        took[r.sequence_id] += r.length * (r.doc_id >= 9000)
    assert all(abs(took[i] - 4096 * share) <= 1100 * 2 for i in range((8 * 6001 + 12000) // 4096))


def test_encoder_equals_library_and_shrinks():
    tok, enc = Tokenizer.from_file(PATH), WordEncoder(PATH, slots=64)
    r = random.Random(1)
    parts = ["<|endoftext|>", "<|EndOfText|>", "it's", "don'T x", "é", "é", "́", "ΣΑΣ", "a b", "\t", "\r\n", "\x1c", "\u0085", "İ", "日本語", "12345", "''s", "'s", "ﬁ", "‍", "a" * 300, "K", "THE", "!!.,"]
    for _ in range(200):
        texts = ["".join(r.choice([*parts, " ", "\n", "  ", "the", "Ab"]) for _ in range(r.randint(0, 40))) for _ in range(3)] + [None]
        flat, lens = enc.encode_with_end(texts)
        want = [x for t in texts for x in tok.encode(t or "", add_special_tokens=False).ids + [2]]
        assert flat.tolist() == want and sum(lens) == len(want)
