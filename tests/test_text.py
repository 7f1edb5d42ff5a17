import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import dialect, memory, origin
from tessera.operators import chunk, entities, facts, search
from tessera.plans import catalogue, model, text_queries as tq


#: Texts whose results are known.
CLAIMS = ["Bob is Alice's brother. Then Alice's friend is Carol.", "Bob is Alice's brother", "no claim", "Dora is Erin's boss and Bobb was there with Alyce"]
FACTS = [("f1", "bob", "brother", "alice", None, "2020-01-01"), ("f2", "bob", "cousin", "alice", None, None), ("f3", "carol", "friend", "alice", None, None), ("f4", "dora", "Boss", "erin", None, "2019-01-01")]
ORIGINS = [
    ("narrative", "The river ran past the old mill and the children followed it down to the sea. " * 4),
    ("brand", "We asked ChatGPT and OpenAI models; the LLM with RAG answered. Claude agreed."),
    ("turns", "user: hello there\nassistant: hi\nuser: more\nassistant: less"),
    ("ambiguous", "Claude played the Opus under a Gemini moon, and the Llama slept through the Mistral. " * 3),
    ("short", "too short"),
]
QUERIES_RAW = ["short question?", "x" * 210, "prompt " * 40 + "\nwhat is the deadline?", "prompt " * 40 + "\nfind the deadline", "y" * 300 + "\n?!", "  \n ", "z" * 260 + "\n" + "w" * 300]
PATHS = [("src/frontend-app/a.ts", "x"), ("interviews/b.md", "the api and the server"), ("ui/c.md", ""), ("docs.md", "api"), ("d.txt", "nothing"), ("lib/e.md", "api react react")]


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "i int, text string")


def slide(text: str | None) -> list[dict]:
    """The walk from cut to cut.

    Overlapping chunks of one text, cut where a paragraph or else a line ends.

    Sizes are bytes; cuts move to the start of a character.  Only where a window
    has no blank line does the last line break count, and either counts in the
    second half of the window only.
    """
    data = (text or "").strip().encode()
    out, at = [], 0

    def inside(i: int) -> bool:
        return 0 < i < len(data) and data[i] & 0xC0 == 0x80

    while at < len(data):
        end = min(at + chunk.SIZE, len(data))
        while inside(end):
            end -= 1
        if end < len(data):
            cut = data.rfind(b"\n\n", at, end)
            if cut < 0:
                cut = data.rfind(b"\n", at, end)
            if cut > at + chunk.SIZE // 2:
                end = cut
        piece = data[at:end].decode().strip()
        if len(piece.encode()) >= chunk.LEAST:
            out.append({"content": piece, "chunk_index": len(out)})
        if end >= len(data):
            break
        at = max(end - chunk.OVERLAP, 0)
        while inside(at):
            at += 1
    return out


def test_slide():
    assert slide("") == [] and slide(None) == [] and slide("x" * 49) == []
    assert slide("  " + "x" * 50 + "\n") == [{"content": "x" * 50, "chunk_index": 0}]
    parts = slide("a" * 500 + "\n\n" + "b" * 500)
    assert parts[0]["content"] == "a" * 500 and parts[1]["content"].endswith("b" * 500)
    parts = slide("a" * 500 + "\n" + "b" * 500)
    assert parts[0]["content"] == "a" * 500
    early = "a" * 100 + "\n\n" + "b" * 450 + "\n" + "c" * 500  # a blank line early keeps the later line end from counting
    assert len(slide(early)[0]["content"]) == 800
    for p in slide("é" * 3000):
        assert len(p["content"].encode()) <= 800
    whole = "".join(chr(97 + i % 26) for i in range(5000))
    assert all(p["content"] in whole for p in slide(whole)) and len(slide(whole)) == 7


def test_exchanges(spark):
    body = "> question one\nanswer a\n\n answer b\n---\nafter the stop\n> second question that is long enough\nshort\n> " + "q" * 900
    got = chunk.by_exchange(spark.createDataFrame([("x", body)], "id string, content string")).orderBy("chunk_index").collect()
    assert [r.content for r in got] == ["> question one\nanswer a answer b", "> second question that is long enough\nshort", "> " + "q" * 798, "q" * 102]


def test_memory_types(spark):
    rows = texts(spark, *tq.MEMORIES).select("i", F.explode(memory.segments(F.col("text"))).alias("segment"))
    got = {r.i: r.kind for r in memory.classified(rows).collect()}
    assert got == {0: "decision", 1: "milestone", 2: "problem", 3: "emotional", 4: "preference"}


def test_segments_and_prose(spark):
    turns = "> one\nanswer\nUser: two\nmore\nAssistant: three"
    got = texts(spark, turns, "p one\n\np two", "\n".join(f"line {i}" for i in range(30)), "```\ncode\n```\nimport os\nsaid it").select(memory.segments(F.col("text")).alias("s"), memory.prose(F.col("text")).alias("p")).collect()
    assert got[0].s == ["> one\nanswer", "User: two\nmore", "Assistant: three"] and got[1].s == ["p one", "p two"] and len(got[2].s) == 2
    assert got[3].p == "said it"


def test_moods_and_flags(spark):
    rows = texts(spark, *tq.MOODS).select("i", F.array_join(dialect.moods(F.col("text")), ",").alias("moods"), F.array_join(dialect.flags(F.col("text")), ",").alias("flags"))
    got = {r.i: (r.moods, r.flags) for r in rows.collect()}
    assert got[0][0] == "anx,excite" and got[1][1] == "DECISION,TECHNICAL" and got[2] == ("", "")


def test_header_fields_round_trip(spark):
    rows = texts(spark, "a|b%7C\n%25c", "plain", "")
    assert all(r.text == r.back for r in rows.select("text", dialect.unescaped(dialect.escaped(F.col("text"))).alias("back")).collect())


def test_compressed_lines_decode(spark):
    docs = spark.createDataFrame([("x", 'We met Alice and Bob. "A very important decision" was made because Rust-lang is fast.')], "id string, content string")
    row = dialect.compressed(docs).select("line", dialect.decoded(F.col("line")).alias("d")).first()
    assert row.d.entities == ["ALI", "BOB", "RUS"] and row.d.sentence == "A very important decision" and "rust-lang" in row.d.topics
    assert row.line.endswith("DECISION")


def test_facts_and_names(spark):
    t = spark.createDataFrame(FACTS, "id string, subject string, predicate string, object string, valid_from string, valid_to string")
    e = spark.createDataFrame([(x.lower(), x) for x in ("Alice", "Bob", "Carol", "Dora", "Erin")], "id string, name string")
    got = sorted((r.i, r.subject, r.predicate, r.object, r.kind) for r in facts.issues(facts.claims(texts(spark, *CLAIMS)), t, e, "2024-01-01").collect())
    assert got == [(0, "Bob", "brother", "Alice", "relationship_mismatch"), (0, "Bob", "brother", "Alice", "stale_fact"), (1, "Bob", "brother", "Alice", "relationship_mismatch"), (1, "Bob", "brother", "Alice", "stale_fact"), (3, "Dora", "boss", "Erin", "stale_fact")]


def test_origin(spark):
    got = {r.corpus: (r.ai_dialogue, r.confidence) for r in origin.corpus_origin(spark.createDataFrame(ORIGINS, "corpus string, text string")).collect()}
    assert got["narrative"] == (False, 0.9) and got["brand"] == (True, 0.95) and got["turns"] == (True, 0.95) and got["ambiguous"] == (False, 0.9) and got["short"] == (True, 0.4)


def test_entities(spark):
    docs = texts(spark, *tq.PEOPLE)
    names = entities.candidates(docs)
    got = {r.name: r.kind for r in entities.capped(entities.classified(names, entities.signals(docs, names))).collect()}
    assert got == {"Clara": "person", "Vortex": "project", "Quill": "uncertain", "North": "uncertain", "Gate": "uncertain"}


def test_rooms(spark):
    rows = spark.createDataFrame(PATHS, "path string, content string").select("path", chunk.file_room(F.col("path"), F.col("content"), tq.ROOMS).alias("room"))
    assert {r.path: r.room for r in rows.collect()} == {"src/frontend-app/a.ts": "frontend", "interviews/b.md": "backend", "ui/c.md": "frontend", "docs.md": "docs", "d.txt": "general", "lib/e.md": "frontend"}


def test_sanitizer(spark):
    rows = texts(spark, *QUERIES_RAW).select("i", search.sanitized(F.col("text")).alias("s"))
    got = {r.i: (r.s.method, len(r.s.query)) for r in rows.collect()}
    assert got[0] == ("passthrough", 15) and got[1] == ("tail_sentence", 210) and got[2][0] == "question_extraction" and got[3][0] == "tail_sentence" and got[4] == ("tail_truncation", 250) and got[5] == ("passthrough", 0) and got[6] == ("tail_sentence", 250)


@pytest.mark.parametrize("name", ["chunk_text"])
def test_chunks_of_documents_equal_the_walk(spark, name):
    sf = "/root/testdata/sf0.001"
    got = {(r.id, r.chunk_index): r.bytes for r in catalogue.QUERIES[name](spark, sf).collect()}
    want = {(r.id, p["chunk_index"]): len(p["content"].encode()) for r in model.drawers(spark, sf).collect() for p in slide(r.content)}
    assert got == want


def test_the_fold_cuts_where_the_walk_cuts(spark):
    r = random.Random(6)
    bits = ["\n", "\n\n", "\n\n\n", " ", "word ", "é" * 7, "日本語" * 30, "𝄞" * 90, "x" * 395, "y" * 401, "a line of text\n", "z" * 800]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(150)] + [None, "", "x" * 49, "x" * 50, "é" * 3000, "q" * 100_000, "a" * 799 + "é" * 5 + "\n" * 900 + "b" * 60]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunk.chunk_text(F.col("t")).alias("c"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    for row in rows.collect():
        assert [x.asDict() for x in row.c] == slide(texts[row.i])


def test_pieces_have_whole_characters(spark):
    texts = ["é" * 1000, "a" * 800, "a" * 801, "𝄞" * 450 + "b", "", "日" * 5000]
    for row in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunk.byte_pieces(F.col("t")).alias("p")).collect():
        assert "".join(row.p) == texts[row.i] and all(0 < len(p.encode()) <= 800 for p in row.p) and all(len(p.encode()) > 796 for p in row.p[:-1])


def test_lines_with_headers_decode_to_what_they_were(spark):
    rows = [(0, "w|%", "?", "", "/a/b.tar.gz", "plain words without anything"), (1, None, None, None, None, "x"), (2, "", "room\n%7C", "2024-01-01", "/x/.hidden", "We decided because Alice was happy, said Bob. core"), (3, "", "", "", "", "")]
    docs = spark.createDataFrame(rows, "id int, wing string, room string, date string, source_file string, content string")
    head = dialect.header(*(F.col(c) for c in ("wing", "room", "date", "source_file")))
    got = {r.id: r for r in dialect.compressed(docs, head=head).select("id", "line", dialect.decoded(F.col("line")).alias("d")).collect()}
    assert [got[i].d[:4] for i in range(4)] == [("w|%", "?", "", "b.tar"), ("", "", "", ""), ("", "room\n%7C", "2024-01-01", ".hidden"), ("", "", "", "")]
    assert got[3].line == "0:???|misc" and got[1].line.startswith("0:???|misc") and got[0].line.startswith("w%7C%25|%3F|?|b.tar\n0:")
    d = got[2].d
    assert d.entities == ["ALI", "BOB"] and "joy" in d.moods and "DECISION" in d.flags and "CORE" in d.flags and d.sentence.startswith("We decided")
    bare = spark.createDataFrame([("0:A+B|t_u",), ("0:???|misc||",)], "line string").select(dialect.decoded(F.col("line")).alias("d")).collect()
    assert bare[0].d.entities == ["A", "B"] and bare[0].d.topics == ["t", "u"] and bare[0].d.sentence == "" and bare[1].d.entities == [] and bare[1].d.topics == []
