import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from tessera.llm import op2
from tessera.llm.pii import find_base, mask, spans_of, written
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_all_documents_match_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = op2.op2_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == digest(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PATTERNS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


HARD = ["a@b.c_x@d.e", "a@b.c@d.e", "x" * 20_000 + " " + "1" * 20_000, "a" * 300 + "@" + "b." * 3000 + "c", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (202) 555-0143 +12 +1(((", "é𝒳 a@b.co 𝒳 +49 30 1234567", "4111 1111 1111 1 255.1.2.3", "", None, "a.@b.c. %@-.-", "1" * 30 + " +" + "1" * 15, "\n".join(f"u{i}@h{i}.org" for i in range(1500))]


def test_hard_texts(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(HARD)] + [(0, HARD[0], 1, "x"), (None, "a@b.co", 1, "x")], "doc_id long, text string, kind int, base string")
    found, _ = spans_of(docs)
    got = found.select("doc_id", written(F.col("base")).alias("s")).collect()
    assert len(got) == len(HARD) + 2
    for r in got:
        text = "a@b.co" if r.doc_id is None else HARD[r.doc_id]
        assert r.s == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text)), (text or "")[:50]
    shown = {r.doc_id: r.text for r in mask(docs).collect()}
    assert shown[11] == "[EMAIL]. [EMAIL]" and shown[9] == "" and shown[10] is None
    assert shown[7] == "é𝒳 [EMAIL] 𝒳 [PHONE]" and shown[1] == "[EMAIL]@d.e" and shown[13].count("[EMAIL]") == 1500
    assert mask(docs).count() == len(HARD) + 2 and mask(docs.limit(0)).count() == 0


ZEROS = ["10.0.0.1 192.168.0.1 255.255.255.0 0.0.0.0", "00.000.0000.1 10.20.30.00 000255.0.0.000255", "0.0.0.256 0000256.0.0.0 1.0.0", "0" * 4000 + ".0.0.1 " + "0" * 4000 + ".0.0.256"]


def test_parts_of_zeros(spark):
    docs = spark.createDataFrame(list(enumerate(ZEROS)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in spans_of(docs)[0].select("doc_id", written(F.col("base")).alias("s")).collect()}
    assert got == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)) for i, t in enumerate(ZEROS)}
    assert [got[i].count("ip:") for i in range(4)] == [4, 3, 0, 1]
    assert mask(docs).filter("doc_id = 0").first().text == " ".join(["[IP]"] * 4)


def test_contexts_find_unseen_identifiers(spark):
    seen = [(i, f"so you can write to me {'x' * (i % 5 + 1)}{i}@mail{i}.org today") for i in range(20)]
    new = [(100, "so you can write to me joe99@localhost today"), (101, "version 10.2beta@x of it")]
    rows = {r.doc_id: r.added for r in spans_of(spark.createDataFrame(seen + new, "doc_id long, text string"))[0].collect()}
    assert [(s.kind, s.start, s.end) for s in rows[100]] == [(0, 23, 38)]
    assert rows[101] == [] and all(rows[i] == [] for i in range(20))
    shaped = [(i, f"my card number is {4111111111111111 + 0 * i} ok") for i in range(20)] + [(50, "my card number is 4111111111111112 ok"), (51, "part 4111111111111112 ok")]
    rows = {r.doc_id: r.added for r in spans_of(spark.createDataFrame(shaped, "doc_id long, text string"))[0].collect()}
    assert [(s.kind, s.start, s.end) for s in rows[50]] == [(2, 18, 34)] and rows[51] == []


def test_contexts_find_unseen_shapes(spark):
    seen = [(i, f"so you can write to me {'x' * (i % 5 + 1)}{i}@mail{i}.org today") for i in range(20)]
    seen += [(i, f"or call me under +49 30 12345{i} today") for i in range(20, 40)]
    long = "x" * 80 + "@localhost"
    new = {100: "so you can write to me joe99@localhost today", 101: f"so you can write to me {long} today", 102: "so you can write to me a@b today", 103: "or call me under 030-1234567 today", 104: "or call me under (202)555-0143 today", 105: "call it 030-7654321.5 now", 106: "see page joe99 of 1joe@here today"}
    rows = {r.doc_id: [(s.kind, s.start, s.end) for s in r.added] for r in spans_of(spark.createDataFrame(seen + list(new.items()), "doc_id long, text string"))[0].collect()}
    assert rows[100] == [(0, 23, 38)] and rows[101] == [(0, 23, 23 + len(long))] and rows[102] == [(0, 23, 26)]
    assert rows[103] == [(3, 17, 28)] and [s[0] for s in rows[104]] == [3]
    assert all(rows[i] == [] for i in [*range(40), 105, 106])


def test_unseen_shapes_count_against_a_pattern(spark):
    seen = [(i, f"so you can write to me x{i}@mail{i}.org today") for i in range(20)]
    plain = [(100 + i, f"so you can write to me {'-' * i}{i} today") for i in range(40)]
    rows = {r.doc_id: r.added for r in spans_of(spark.createDataFrame([*seen, *plain, (200, "so you can write to me joe99@localhost today")], "doc_id long, text string"))[0].collect()}
    assert all(not added for added in rows.values())


def masked(text, spans):
    out, at = "", 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2], [*PATTERNS].index(s[0]))):
        out += f"{text[at:a]}[{k.upper()}]" if a >= at else ""
        at = max(at, b)
    return out + text[at:]


def test_mask_and_tokens_of_many_spans(spark):
    some = ["a{0}@b{0}.co", "10.0.{1}.7", "é𝒳x{0}", "+49 30 12345{0}", "4111 1111 1111 1111", "+4111111111111111 y", "plain"]
    texts = ["\n".join(some[(i * k + i // 3) % 7].format(i, i % 256) for i in range(n)) for k, n in ((1, 2000), (2, 511), (3, 512), (5, 513), (1, 7))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in mask(docs, least=2.0).collect()}
    assert got == {i: masked(t, brute(t)) for i, t in enumerate(texts)}
    tokens = {r.doc_id: [(x.start, x.end, x.text) for x in r.tokens] for r in find_base(docs).collect()}
    for i, t in enumerate(texts):
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S*[0-9@]\S*", t)]
        spans = brute(t)
        assert tokens[i] == [w for w in words if not any(a < w[1] and w[0] < b for _, a, b in spans)]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single(spark, n):
    docs = spark.createDataFrame([(1, None)][:n], "doc_id long, text string")
    assert spans_of(docs)[0].count() == n


def test_long_words_before_and_clashing_names(spark):
    long = "w" * 70
    docs = [(i, f"some {long} \n {long} x{i}@mail{i}.org") for i in range(20)] + [(50, f"some {long} {long}\t joe99@localhost"), (51, f"some w{long} {long} 9joe@localhost")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as cut", "2 as row", "3 as of", "'h' as text_hash", "4 as _h", "5 as base")
    got = {r.doc_id: r for r in mask(df).collect()}
    assert got[50].text == f"some {long} {long}\t [EMAIL]" and got[51].text.endswith("9joe@localhost")
    assert mask(df).columns == df.columns and tuple(got[51][2:]) == (1, 2, 3, "h", 4, 5)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["0", "00", "25", "5", "255", "256", "1", "9", ".", ".", ".", "@", "a", "b-", "+", "-", " ", "(", ")", "4111111111111111", "é", "%"]), max_size=24).map("".join), min_size=100, max_size=200))
def test_base_spans_by_chance(spark, texts):
    found = find_base(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", written(F.col("base")).alias("s")).collect()
    assert {r.doc_id: r.s for r in found} == {i: ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)) for i, t in enumerate(texts)}
