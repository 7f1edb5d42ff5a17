import random
import re

from hypothesis import given, settings, strategies as st

from tessera.operators import entities
from tessera.operators.facts import similar_names
from tessera.operators.fuzzy import near_names
from tessera.operators.mentions import MARK, contexts, mentions
from tessera.operators.registry import people_in


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close(names):
    names = sorted({n for n in names if n is not None})
    return {(a, b, d) for a in names for b in names if 1 <= (d := distance(a.lower(), b.lower())) <= 2}


def test_near_names(spark):
    r = random.Random(2)
    word = lambda a, b: "".join(r.choice("abcé d") for _ in range(r.randint(a, b)))

    def bent(s):
        for _ in range(r.randint(1, 3)):
            i = r.randint(0, len(s))
            s = r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice("abX") + s[i:], s[:i] + "q" + s[i + 1 :]])
        return s

    base = [word(1, 6) for _ in range(50)] + [word(18, 40) for _ in range(30)]
    names = base + [bent(b) for b in base for _ in range(3)] + [None, "", "A", "a", "aB", "Ab", "x" * 90, "x" * 89 + "y", "x" * 92]
    got = {tuple(x) for x in near_names(spark.createDataFrame([(n,) for n in names + names[:5]], "name string")).collect()}
    assert got == close(names)
    assert any(len(a) > 30 for a, _, _ in got)


def held(names, text):
    return {n for n in names if re.search(rf"(?i)(?<![^\W]){re.escape(n)}(?![^\W])", text)}


def test_mentions_and_contexts(spark):
    texts = [(0, "Bob met Ann-Marie; bob's Vortexv2 and VORTEX-core."), (1, None), (2, ""), (3, "Old North  Gate, Old North Gate"), (4, "aBob Bob_ Bob"), (5, "日本 Émile émile")]
    names = ["Bob", "Ann-Marie", "Vortex", "Old North Gate", "Émile", "-x", "", None, "Marie"]
    t = spark.createDataFrame(texts, "i int, text string")
    n = spark.createDataFrame([(x,) for x in names + ["Bob"]], "name string")
    got = sorted(tuple(x) for x in mentions(t, n).collect())
    assert got == sorted([(0, "Bob", 1), (0, "Bob", 9), (0, "Ann-Marie", 5), (0, "Marie", 7), (0, "Vortex", 17), (3, "Old North Gate", 7), (4, "Bob", 5), (5, "Émile", 3), (5, "Émile", 5)])
    found = {(r.i, r.name, r.context, r.version) for r in contexts(t, n).collect()}
    assert (0, "Vortex", f"bob's {MARK} and VORTEX", True) in found
    assert (0, "Bob", f"{MARK} met Ann", False) in found and (0, "Vortex", f"Vortexv2 and {MARK}-core.", False) in found
    assert mentions(t, n.limit(0)).collect() == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("aAbB _-.é", max_size=20), min_size=1, max_size=6), st.lists(st.text("aAbB é-", min_size=1, max_size=4), min_size=1, max_size=6))
def test_mentions_equal_whole_word_search(spark, texts, names):
    names = [n for n in names if re.match(r"\w", n[0]) and re.match(r"\w", n[-1])]
    got = {(r.i, r.name) for r in mentions(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in held(names, t)}


def test_similar_names_and_people(spark):
    names = ["Alice", "Alyce", "Alise", "Bob", "Bobb", "Old North Gate", "Old North Gates"]
    texts = [(0, "alice and alyce"), (1, "Bobb"), (2, "the old north gate"), (3, None)]
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {tuple(x) for x in similar_names(spark.createDataFrame(texts, "i int, text string"), n).collect()}
    assert got == {(0, "Alice", "Alise", 1), (0, "Alyce", "Alise", 2), (1, "Bobb", "Bob", 1), (2, "Old North Gate", "Old North Gates", 1)} or got == {(i, a, b, d) for i, t in texts if t for a in held(names, t) for b in names if b not in held(names, t) and 1 <= (d := distance(a.lower(), b.lower())) <= 2}
    people = spark.createDataFrame([("Robert", "Bob"), ("Robert", "Robert"), ("Ann", "Ann-Marie")], "name string, alias string")
    asked = people_in(spark.createDataFrame([("is bob in?",), ("ann-marie, Robert and BOB",), ("bobby",)], "query string"), people)
    assert sorted(map(tuple, asked.collect())) == [("ann-marie, Robert and BOB", "Ann"), ("ann-marie, Robert and BOB", "Robert"), ("is bob in?", "Robert")]


def scored(texts, names):
    """The signals of names by a regular expression for each name and pattern."""
    out = {}
    for name in names:
        e, v, t, h, p, project = re.escape(name), 0, 0, 0, 0, 0
        count = lambda pat, s, flags=re.I: len(re.findall(pat.format(e) if "{}" in pat else pat, s, flags))
        for s in texts:
            if s is None:
                continue
            v += 2 * sum(len(re.findall(rf"(?i)\b{e}\s+{x}\b", s)) for x in entities.VERBS)
            t += 2 * sum(len(re.findall(x.replace("{}", e), s, re.I | re.M)) for x in (r"^>\s*{}[:\s]", r"^{}:\s", r"^\[{}\]")) + len(re.findall(entities.SAID.replace("{}", e), s, re.I | re.M))
            h += 2 * sum(len(re.findall(x.replace("{}", e), s, re.I)) for x in (r"\bhey\s+{}\b", r"\bthanks?\s+{}\b", r"\bhi\s+{}\b")) + len(re.findall(entities.DEAR.replace("{}", e), s, re.I))
            project += 2 * sum(len(list(re.finditer(x.replace("{}", e), s, re.I))) for x in entities.PROJECT + entities.LOCAL_PROJECT) + 3 * len(re.findall(rf"(?i)\b{e}[-v][A-Za-z0-9_]+", s))
            lines = re.split(r"\r?\n", s)
            lines = lines[:-1] if lines[-1] == "" else lines
            p += sum(1 for i, line in enumerate(lines) if re.search(rf"(?i)\b{e}\b", line) and re.search(entities.PRONOUN, " ".join(lines[max(0, i - 2) : i + 3])))
        if any((v, t, h, p, project)):
            out[name] = (2 * v + 3 * t + 4 * h + 2 * p, sum(x > 0 for x in (v, t, h, p)), project)
    return out


def test_signals_equal_a_search_for_each_name(spark):
    r = random.Random(11)
    names = ["Clara", "Vortex", "Old Gate", "Quill", "Ünal"]
    around = ["{} said", "{}\n asked", "hey {}", "Thanks {}", "dear  {}", "building {}", "deployed {} v2", "the {}\tpipeline", "import {}", "pip install {}", "{}.py", "{}-core", "{}v3", "{}: hi", "\n> {}: x", "\n[{}] y", '"{} said', "\n{}: ", "she", "they left\n", "\r\n", "\n\n\n", "plain words.", "{}", "{}s", "x{}"]
    texts = [" ".join(r.choice(around).format(r.choice(names)) for _ in range(r.randint(0, 25))) for _ in range(40)]
    texts += [texts[0], None, "", "Clara", "> Clara\n> Clara\n"]
    n = spark.createDataFrame([(x,) for x in names], "name string")
    want = scored(texts, names)
    for ident in (None, "i"):
        got = {x.name: (x.person, x.kinds, x.project) for x in entities.signals(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), n, ident=ident).collect()}
        assert {k: v for k, v in got.items() if v != (0, 0, 0)} == want


def test_signals_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang = 'en'").select("doc_id", "text")
    names = entities.candidates(docs).orderBy("name").limit(40)
    got = {x.name: (x.person, x.kinds, x.project) for x in entities.signals(docs, names, ident="doc_id").collect()}
    want = scored([x.text for x in docs.collect()], [x.name for x in names.collect()])
    assert {k: v for k, v in got.items() if v != (0, 0, 0)} == want
