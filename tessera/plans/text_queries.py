"""Queries over texts and messages, and their SQL.

The tables hold no markers, claims or brand terms, so the queries on those put a
sentence beside the text of each row, by its key; all rows and whole texts count.
"""

from __future__ import annotations

import re

from pyspark.sql import Window as W, functions as F

from tessera.functions import dialect, memory, origin
from tessera.functions.text import token_estimate
from tessera.operators import chunk, entities, facts, messages, search
from tessera.operators.fuzzy import near_names
from tessera.operators.mentions import MARK
from tessera.plans import model as M
from tessera.runtime import materialize

MEMORIES = [
    "We decided to use GraphQL instead of REST because it gives better flexibility for our frontend queries.",
    "The bug was that the database connection was timing out. After investigation, we fixed it by increasing the pool size.",
    "The bug is causing the database connection to crash repeatedly. The system keeps failing under load and we need to investigate further.",
    "I'm so proud of what we built together. It's beautiful and amazing to see it all come together.",
    "I prefer snake_case for all variable names. I always use functional style over imperative when possible.",
    "nothing to see here at all, move along",
    "short bug",
]
MOODS = ["I'm really excited but also worried about the deadline", "We decided to switch because the old API was too slow", "plain words", "they were happy, sad, curious and surprised; the core principle was realized"]
BRANDED = ["We asked ChatGPT and OpenAI models; the LLM with RAG answered.", "user: hello there\nassistant: hi", "Claude played the Opus under a Gemini moon.", ""]
TALKS = [*MEMORIES, *MOODS, "the roadmap and sprint plan", "code code code", "layer service and git api"]
PEOPLE = [
    "Clara said she was late. Hey Clara, are you there? Clara asked for tea. Clara: hello\nthen they left with Clara",
    "We are building Vortex and deployed Vortex v2. The Vortex pipeline runs import Vortex daily. Old North Gate stood. Old North Gate fell. Old North Gate rose.",
    "Quill met Quill and Quill, said nobody.",
]
ASKED = ["what is the deadline?", "find the deadline", "?!", "", "w" * 300]
ROOMS = [("frontend", ["ui", "react"]), ("backend", ["api", "server"]), ("docs", [])]
FOLDERS, STEMS, WORDS = ["src/frontend-app", "interviews", "ui", "lib/api", "d", "Docs"], ["note", "docs", "react", "a"], ["api react react", "the api and the server", "", "DOCS"]


def _beside(spark, sf, phrases, first=False):
    """(i, text): messages on one line with one of ``phrases`` behind, or before, by session and turn."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    phrase = F.get(F.array(*[F.lit(p) for p in phrases]), ((F.col("session") * 3 + F.col("turn")) % len(phrases)).cast("int"))
    return M.messages(spark, sf).select(F.col("uuid").alias("i"), F.concat_ws(" ", *((phrase, said) if first else (said, phrase))).alias("text"))


def memory_types(spark, sf):
    rows = _beside(spark, sf, MEMORIES).select("i", F.posexplode(memory.segments(F.col("text"))).alias("at", "segment"))
    return memory.classified(rows).select("i", "kind", M.rounded(F.col("confidence")).alias("confidence"))


def emotions_flags(spark, sf):
    return _beside(spark, sf, MOODS).select("i", F.array_join(dialect.moods(F.col("text")), ",").alias("moods"), F.array_join(dialect.flags(F.col("text")), ",").alias("flags"))


def topics_top3(spark, sf):
    return dialect.topics(M.drawers(spark, sf), "id", "content").select("id", "rank", "topic", "score")


def key_sentence(spark, sf):
    return M.drawers(spark, sf).select("id", dialect.key_sentence(F.col("content")).alias("sentence"))


def token_estimates(spark, sf):
    return M.drawers(spark, sf).select("id", token_estimate(F.col("content")).alias("tokens"))


def compress_lines(spark, sf):
    return dialect.compressed(M.drawers(spark, sf)).select("id", "line", M.rounded(F.col("ratio")).alias("ratio"))


def line_round_trip(spark, sf):
    """Lines with headers of awkward fields, decoded again."""
    d = M.drawers(spark, sf)
    wing = F.concat("wing", F.when(F.col("doc_id") % 4 == 0, "|50%\n%7C").otherwise(""))
    head = dialect.header(wing, F.when(F.col("doc_id") % 3 == 0, "?").otherwise(F.col("room")), F.date_format("filed_at", "yyyy-MM-dd"), F.col("source_file"))
    x = dialect.compressed(d, head=head).select("id", dialect.decoded(F.col("line")).alias("d"))
    lists = ("entities", "topics", "moods", "flags")
    return x.select("id", *[f"d.{c}" for c in ("wing", "room", "date", "stem", "sentence")], *[F.array_join(f"d.{c}", ",").alias(c) for c in lists])


def compress_totals(spark, sf):
    d = M.drawers(spark, sf)
    lines = dialect.compressed(d).select("id", "line")
    return d.join(lines, "id").agg(F.sum(F.octet_length("content")).alias("bytes"), F.sum(F.octet_length("line")).alias("compressed"))


def chunk_text(spark, sf):
    return M.drawers(spark, sf).select("id", F.inline(chunk.chunk_text(F.col("content")))).select("id", "chunk_index", F.octet_length("content").alias("bytes"), F.md5(F.col("content").cast("binary")).alias("md5"))


def chunk_text_plain(spark, sf):
    """Chunks of the drawers with an x for each character beyond ASCII, so that bytes and characters agree."""
    plain = F.regexp_replace("content", r"[^\x00-\x7F]", "x")
    return M.drawers(spark, sf).select("id", F.inline(chunk.chunk_text(plain))).select("id", "chunk_index", F.octet_length("content").alias("bytes"), F.md5(F.col("content").cast("binary")).alias("md5"))


def chunk_paragraph(spark, sf):
    return M.drawers(spark, sf).select("id", F.inline(chunk.by_paragraph(F.col("content")))).select("id", "chunk_index", F.octet_length("content").alias("bytes"))


def _transcripts(spark, sf, beyond=None):
    m = messages.dialogue(M.messages(spark, sf))
    m = m if beyond is None else m.withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", beyond))
    m = m.withColumn("line", F.concat(F.when(F.col("role") == "user", "> ").otherwise(""), F.regexp_replace("text", r"\s+", " ")))
    return m.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("content")).select(F.col("session").cast("string").alias("id"), "content")


def chunk_exchange(spark, sf):
    return chunk.by_exchange(_transcripts(spark, sf)).select("id", "chunk_index", F.octet_length("content").alias("bytes"))


def chunk_exchange_plain(spark, sf):
    """Exchanges with an x for each character beyond ASCII, so that bytes and characters agree."""
    return chunk.by_exchange(_transcripts(spark, sf, "x")).select("id", "chunk_index", F.md5(F.col("content").cast("binary")).alias("md5"))


def convo_room(spark, sf):
    return _beside(spark, sf, TALKS, True).select("i", chunk.conversation_room(F.col("text")).alias("room"))


def file_room(spark, sf):
    """A file for each document in one of a few folders, with some words before its text."""
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(F.col("doc_id") / k) % len(xs) + 1).cast("int"))
    d = M.drawers(spark, sf).select("doc_id", F.concat(pick(FOLDERS, 1), F.lit("/"), pick(STEMS, 6), F.lit(".md")).alias("path"), F.concat(pick(WORDS, 24), F.lit(" "), "content").alias("content"))
    return d.select("doc_id", chunk.file_room(F.col("path"), F.col("content"), ROOMS).alias("room"))


def exchange_pairs(spark, sf):
    return messages.exchanges(M.messages(spark, sf))


def sweep_ids(spark, sf):
    return messages.sweep_drawers(M.messages(spark, sf)).select("id", "role")


def sweep_new_only(spark, sf):
    """Messages that a store of all first questions lacks."""
    all_ = messages.sweep_drawers(M.messages(spark, sf))
    stored = messages.sweep_drawers(M.messages(spark, sf).filter("turn < 2"))
    return messages.only_new(all_.unionAll(all_), stored).select("id")


def themes_recent(spark, sf):
    return messages.themes(M.messages(spark, sf)).select("session", "rank", "theme", "n")


def session_saves(spark, sf):
    return messages.saves(M.messages(spark, sf))


def slack_roles(spark, sf):
    """Customers of each nation's orders as speakers of one chat, by first order."""
    o = M.table(spark, sf, "orders").join(M.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    first = o.groupBy(F.col("c_nationkey").alias("chat"), F.col("o_custkey").alias("speaker")).agg(F.min("o_orderkey").alias("at"))
    rank = F.row_number().over(W.partitionBy("chat").orderBy("at"))
    return first.select("chat", "speaker", F.when(rank % 2 == 1, "user").otherwise("assistant").alias("role"))


def entity_candidates(spark, sf):
    return entities.candidates(M.drawers(spark, sf), "content")


def _told(spark, sf):
    """Drawers and messages as texts, every seventh message with one of a few sentences about a person or project behind it."""
    extra = F.get(F.array(*[F.lit(p) for p in PEOPLE]), F.col("turn") % len(PEOPLE))
    said = F.concat(F.coalesce("text", F.lit("")), F.when((F.col("session") + F.col("turn")) % 7 == 0, F.concat(F.lit("\n"), extra)).otherwise(""))
    return M.drawers(spark, sf).select("id", F.col("content").alias("text")).unionAll(M.messages(spark, sf).select(F.col("uuid").alias("id"), said.alias("text")))


def _scored(spark, sf):
    texts = _told(spark, sf)
    names = materialize(entities.candidates(texts), "candidates")
    return names, entities.signals(texts, names, ident="id")


def entity_scores(spark, sf):
    names, scores = _scored(spark, sf)
    return names.join(scores, "name", "left").fillna(0, ["person", "kinds", "project"]).select("name", "n", F.col("person").cast("long").alias("person"), F.col("kinds").cast("long").alias("kinds"), F.col("project").cast("long").alias("project"))


def entity_class(spark, sf):
    return entities.capped(entities.classified(*_scored(spark, sf))).select("name", "n", "kind", M.rounded(F.col("confidence")).alias("confidence"))


def fact_issues(spark, sf):
    """Two claims about each customer; what is known of it is right, another word, or over."""
    c = M.table(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.concat(F.lit("C"), "c_custkey").alias("s"), F.concat(F.lit("Nation"), "c_nationkey").alias("o"))
    texts = c.select("i", F.concat(F.lit("They say "), "s", F.lit(" is "), "o", F.lit("'s client. But "), "o", F.lit("'s friend is "), "s", F.lit(".")).alias("text"))
    known = F.when(F.col("i") % 2 == 0, "client").otherwise("Friend")
    end = F.when(F.col("i") % 3 == 0, F.lit("2020-01-01")).when(F.col("i") % 5 == 0, F.lit("2030-01-01"))
    t = c.select(F.concat(F.lit("f"), "i").alias("id"), F.lower("s").alias("subject"), known.alias("predicate"), F.lower("o").alias("object"), F.lit(None).cast("string").alias("valid_from"), end.alias("valid_to"))
    e = c.select(F.lower("o").alias("id"), F.col("o").alias("name")).distinct()
    return facts.issues(facts.claims(texts), t, e, "2024-01-01").select("i", "subject", "predicate", "object", "kind", "known", "valid_to")


def similar_names(spark, sf):
    """Parts whose label holds a name that another name is close to."""
    p = M.part_names(spark, sf)
    texts = p.select(F.col("p_partkey").alias("i"), F.concat(F.lit("one "), "label", F.lit(" of "), "p_name", F.lit(" here")).alias("text"))
    return facts.similar_names(texts, p.select(F.explode(F.array("p_name", "label")).alias("name")).distinct())


def near_names_of_tables(spark, sf):
    """Names of customers, suppliers and parts that are one or two edits apart."""
    p = M.part_names(spark, sf).select(F.explode(F.array("p_name", "label")).alias("name"))
    c = M.table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    return near_names(p.unionAll(c).unionAll(M.table(spark, sf, "supplier").select(F.col("s_name").alias("name"))))


def corpus_origin(spark, sf):
    """Wings and their rooms as corpora; some rooms speak of models, some in turns."""
    phrase = F.get(F.array(*[F.lit(p) for p in BRANDED]), (F.length("room") + F.length("wing") + F.ascii(F.substring("room", 1, 1)) + F.ascii(F.substring("wing", -1, 1))) % len(BRANDED))
    rows = M.drawers(spark, sf).select(F.concat_ws("/", "wing", "room").alias("corpus"), F.concat("content", F.lit("\n"), phrase).alias("text"))
    return origin.corpus_origin(rows).withColumn("confidence", M.rounded(F.col("confidence")))


def documents_origin(spark, sf):
    rows = origin.corpus_origin(M.drawers(spark, sf).select(F.col("wing").alias("corpus"), F.col("content").alias("text")))
    return rows.select("corpus", "brands", "turns", "ai_dialogue", M.rounded(F.col("confidence")).alias("confidence"))


def query_sanitizer(spark, sf):
    """Messages as prompts, with a line behind each by session and turn."""
    line = F.get(F.array(*[F.lit(x) for x in ASKED]), ((F.col("session") * 3 + F.col("turn")) % len(ASKED)).cast("int"))
    asked = M.messages(spark, sf).select(F.col("uuid").alias("i"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line).alias("text"))
    return asked.select("i", search.sanitized(F.col("text")).alias("s")).select("i", "s.query", "s.method")


_D = f"WITH {M.DRAWERS}"
_N = lambda c, ps: " + ".join(f"len(regexp_extract_all({c}, '{p.replace(chr(39), chr(39) * 2)}'))" for p in ps)
_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_FIRST = lambda signals: "list_slice(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{c}' END" for w, c in signals) + "], lambda x: x IS NOT NULL), 1, 99)"
_DISTINCT3 = lambda e: f"array_to_string(list_slice(list_transform(list_filter(list_zip({e}, range(1, 100)), lambda z: z[1] IS NOT NULL AND list_position({e}, z[1]) = z[2]), lambda z: z[1]), 1, 3), ',')"
_ROOM = " UNION ALL ".join(f"SELECT i, '{r}' AS room, {k} AS place, " + " + ".join(f"CAST(contains(lower(substr(text, 1, 3000)), '{w}') AS INTEGER)" for w in ws) + " AS score FROM corpus" for k, (r, ws) in enumerate(chunk.TOPIC_WORDS.items()))
_MSG = f"WITH {M.MESSAGES}, d AS (SELECT * FROM messages WHERE role IN ('user', 'assistant') AND trim(text) <> '')"
_POINTS = " + ".join(f"2 * CAST(contains(lower(s), '{w}') AS INTEGER)" for w in dialect.KEY_WORDS)
_TEXT = lambda x: "'" + x.replace("'", "''") + "'"
_ARRAY = lambda xs: "[" + ", ".join(map(_TEXT, xs)) + "]"


def _beside_sql(phrases: list[str], first: bool = False) -> str:
    said, phrase = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))", f"{_ARRAY(phrases)}[(session * 3 + turn) % {len(phrases)} + 1]"
    return f"WITH {M.MESSAGES}, corpus AS (SELECT uuid AS i, {' || chr(32) || '.join((phrase, said) if first else (said, phrase))} AS text FROM messages)"


def _cut_sql(at: str) -> str:
    w = f"reverse(substr(c, {at} + 1, 800))"
    found = f"CASE WHEN contains({w}, chr(10) || chr(10)) THEN 799 - strpos({w}, chr(10) || chr(10)) WHEN contains({w}, chr(10)) THEN 800 - strpos({w}, chr(10)) ELSE -1 END"
    return f"CASE WHEN {at} + 800 >= length(c) THEN length(c) WHEN ({found}) > 400 THEN {at} + ({found}) ELSE {at} + 800 END"


_TERM = lambda t: "(?i)" + (r"\b" if t[0].isalnum() else "") + re.escape(t) + (r"\b" if t[-1].isalnum() else "")
_PICK = lambda xs, k: f"{_ARRAY(xs)}[doc_id // {k} % {len(xs)} + 1]"
_COUNT = lambda w: f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}"
_TOLD = f"told AS (SELECT id, content AS text FROM drawers UNION ALL SELECT uuid, coalesce(text, '') || CASE WHEN (session + turn) % 7 = 0 THEN chr(10) || [{', '.join(map(_TEXT, PEOPLE))}][turn % {len(PEOPLE)} + 1] ELSE '' END FROM messages)"
#: Words and what parts them, in order; names are capitalised words, and runs of them that only white space parts.
_CANDIDATES = f"""pieces AS (SELECT id, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS p FROM told),
each AS (SELECT id, unnest(p) AS w, generate_subscripts(p, 1) AS k FROM pieces),
caps AS (SELECT id, k, w, lag(w) OVER o AS gap, lag(w, 2) OVER o AS before FROM each WINDOW o AS (PARTITION BY id ORDER BY k)),
starts AS (SELECT id, k, w, gap, CAST(NOT (coalesce(regexp_full_match(before, '[A-Z][a-z]+'), false) AND regexp_full_match(gap, '[ \\t\\n\\x0B\\f\\r]+')) AS INTEGER) AS fresh FROM caps WHERE regexp_full_match(w, '[A-Z][a-z]+')),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY k) AS run FROM starts),
phrases AS (SELECT string_agg(CASE WHEN fresh = 1 THEN w ELSE gap || w END, '' ORDER BY k) AS name FROM runs GROUP BY id, run HAVING count(*) > 1),
found AS (SELECT w AS name FROM starts WHERE length(w) BETWEEN 2 AND 20 UNION ALL SELECT name FROM phrases),
names AS (SELECT name, count(*) AS n FROM found WHERE len(list_intersect(regexp_split_to_array(lower(name), '\\s+'), {_LIST(dict.fromkeys(entities.NO_NAMES))})) = 0 GROUP BY name HAVING count(*) >= 3)"""
_IN = lambda t, flags="(?i)": f"CAST(NOT version AND regexp_matches(c, {_TEXT(flags + entities._marked(t))}) AS INTEGER)"
_ADD = lambda ts, flags="(?i)": "(" + " + ".join(_IN(t, flags) for t in ts) + ")"
_VERB = tuple(rf"\b{{}}\s+{v}\b" for v in entities.VERBS)
#: Mentions by width, and of names before a v that goes on, with the four pieces on both sides.
_SPAN = lambda a, b: f"coalesce(string_agg(w, '') OVER (PARTITION BY id ORDER BY k ROWS BETWEEN {a} AND {b}), '')"
#: Pieces of the widest name that the SQL looks for.
_WIDTHS = (1, 3, 5, 7, 9)
_UPTO = lambda n: f"{n} FOLLOWING" if n else "CURRENT ROW"
_SIGNALS = f"""plain AS (SELECT id, unnest(p) AS w, generate_subscripts(p, 1) AS k FROM (SELECT id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS p FROM told)),
sides AS (SELECT id, k, w, {_SPAN("4 PRECEDING", "1 PRECEDING")} AS before, {", ".join(f"{_SPAN('CURRENT ROW', _UPTO(n - 1))} AS key{n}, {_SPAN(_UPTO(n), _UPTO(n + 3))} AS after{n}, lead(w, {n - 1}) OVER (PARTITION BY id ORDER BY k) AS last{n}" for n in _WIDTHS)} FROM plain),
spans AS ({" UNION ALL ".join(f"SELECT id, {n} AS n, lower(key{n}) AS key, last{n} AS last, before, after{n} AS after FROM sides WHERE last{n} IS NOT NULL AND regexp_matches(w, '^[\\p{{L}}\\p{{N}}_]')" for n in _WIDTHS)}),
hits AS (SELECT id, n, key, before, after, false AS version FROM spans UNION ALL SELECT id, n, key[1:length(key) - length(last) + j], before, after, true FROM (SELECT *, unnest(range(1, length(last) - 1)) AS j FROM spans WHERE regexp_matches(last, '(?i).v[A-Za-z0-9_]')) WHERE regexp_matches(last[j + 1:j + 2], '(?i)^v[A-Za-z0-9_]')),
wide AS (SELECT name, lower(name) AS key, len(regexp_extract_all(name, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')) AS n FROM names),
mine AS (SELECT wide.name, version, before || '{MARK}' || after AS c FROM hits JOIN wide USING (key, n)),
told2 AS (SELECT name, 2 * {_ADD(_VERB)} AS v, 2 * ({_ADD(entities.TALK, "(?im)")}) + {_IN(entities.SAID, "(?im)")} AS t, 2 * {_ADD(entities.HAIL)} + {_IN(entities.DEAR)} AS h,
  2 * {_ADD(entities.PROJECT + entities.LOCAL_PROJECT)} + 3 * greatest(CAST(version AS INTEGER), {_IN("{}-[A-Za-z0-9_]+")}) AS project FROM mine),
lines AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT id, regexp_split_to_array(text, '\\r?\\n') AS l FROM told))),
close AS (SELECT * FROM (SELECT id, k, line, bool_or(regexp_matches(line, {_TEXT(entities.PRONOUN)})) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lines) WHERE near),
lp AS (SELECT id, k, unnest(p) AS w, generate_subscripts(p, 1) AS j FROM (SELECT id, k, regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS p FROM close)),
lk AS (SELECT id, k, w, {", ".join(f"string_agg(w, '') OVER (PARTITION BY id, k ORDER BY j ROWS BETWEEN CURRENT ROW AND {_UPTO(n - 1)}) AS key{n}, lead(w, {n - 1}) OVER (PARTITION BY id, k ORDER BY j) AS last{n}" for n in _WIDTHS)} FROM lp),
ln AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(f"SELECT id, k, {n} AS n, lower(key{n}) AS key FROM lk WHERE last{n} IS NOT NULL AND regexp_matches(w, '^[\\p{{L}}\\p{{N}}_]')" for n in _WIDTHS)})),
ps AS (SELECT name, count(*) AS p FROM ln JOIN wide USING (key, n) GROUP BY 1),
sums AS (SELECT name, sum(v) AS v, sum(t) AS t, sum(h) AS h, sum(project) AS project FROM told2 GROUP BY 1),
scored AS (SELECT name, n, CAST(2 * coalesce(v, 0) + 3 * coalesce(t, 0) + 4 * coalesce(h, 0) + 2 * coalesce(p, 0) AS BIGINT) AS person,
  CAST(CAST(coalesce(v, 0) > 0 AS INTEGER) + CAST(coalesce(t, 0) > 0 AS INTEGER) + CAST(coalesce(h, 0) > 0 AS INTEGER) + CAST(coalesce(p, 0) > 0 AS INTEGER) AS BIGINT) AS kinds, CAST(coalesce(project, 0) AS BIGINT) AS project FROM names LEFT JOIN sums USING (name) LEFT JOIN ps USING (name))"""
ORACLE_SQL = {
    "emotions_flags": f"{_beside_sql(MOODS)} SELECT i, {_DISTINCT3(_FIRST(dialect.MOODS))} AS moods, {_DISTINCT3(_FIRST([(w, f) for f, ws in dialect.FLAGS for w in ws]))} AS flags FROM corpus",
    "memory_types": f"""{_beside_sql(MEMORIES)}, s AS (SELECT i, text, {', '.join(f'({_N("lower(text)", ps)}) AS {k}' for k, ps in memory.MARKERS.items())},
  len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')), {_LIST(memory.POSITIVE)})) > len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')), {_LIST(memory.NEGATIVE)})) AS good,
  ({_N("lower(text)", memory.RESOLUTION)}) > 0 AS resolved FROM corpus WHERE strlen(text) >= 20),
b AS (SELECT *, greatest(decision, preference, milestone, problem, emotional) AS top FROM s)
SELECT i, CASE WHEN emotional = top THEN 'emotional' WHEN problem = top THEN CASE WHEN resolved THEN CASE WHEN emotional > 0 AND good THEN 'emotional' ELSE 'milestone' END WHEN good AND milestone > 0 THEN 'milestone' WHEN good AND emotional > 0 THEN 'emotional' ELSE 'problem' END
  WHEN milestone = top THEN 'milestone' WHEN preference = top THEN 'preference' ELSE 'decision' END AS kind, round(least(1.0, (top + CASE WHEN strlen(text) > 500 THEN 2 WHEN strlen(text) > 200 THEN 1 ELSE 0 END) / 5.0), 6) AS confidence FROM b WHERE top > 0""",
    "topics_top3": f"""{_D}, w AS (SELECT id, unnest(regexp_extract_all(content, '[a-zA-Z][a-zA-Z_-]{{2,}}')) AS w FROM drawers),
t AS (SELECT id, lower(w) AS topic, sum(1 + 2 * CAST(regexp_matches(w, '^[A-Z]') AS INTEGER) + 2 * CAST(regexp_matches(w, '[_-]|^.+[A-Z]') AS INTEGER)) AS score FROM w WHERE lower(w) NOT IN ({', '.join(f"'{x}'" for x in dialect.NO_TOPICS)}) GROUP BY 1, 2)
SELECT * FROM (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) AS INTEGER) AS rank, topic, CAST(score AS BIGINT) AS score FROM t) WHERE rank <= 3""",
    "key_sentence": f"""{_D}, s AS (SELECT id, unnest(regexp_split_to_array(content, '[.!?\\n]+')) AS s, generate_subscripts(regexp_split_to_array(content, '[.!?\\n]+'), 1) AS k FROM drawers),
t AS (SELECT id, k, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM s), p AS (SELECT id, k, s, {_POINTS} + CAST(length(s) < 80 AS INTEGER) + CAST(length(s) < 40 AS INTEGER) - 2 * CAST(length(s) > 150 AS INTEGER) AS points FROM t WHERE strlen(s) > 10),
b AS (SELECT id, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY points DESC, k) AS r FROM p) WHERE r = 1),
qs AS (SELECT id, regexp_extract_all(content, '"([^"]+)"', 1) AS qs FROM drawers), qe AS (SELECT id, regexp_replace(unnest(qs), '^\\s+|\\s+$', '', 'g') AS q, generate_subscripts(qs, 1) AS k FROM qs),
qb AS (SELECT id, q FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(q) DESC, k DESC) AS r FROM qe WHERE length(q) > 10) WHERE r = 1)
SELECT d.id, translate(coalesce(q, CASE WHEN length(s) > 55 THEN substr(s, 1, 52) || '...' ELSE s END, ''), '|' || chr(10) || chr(13), '/  ') AS sentence FROM drawers d LEFT JOIN b USING (id) LEFT JOIN qb USING (id)""",
    "token_estimates": f"{_D} SELECT id, CAST(greatest(1, (len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) * 13 + 5) // 10) AS INTEGER) AS tokens FROM drawers",
    "chunk_text_plain": f"""{_D.replace("WITH", "WITH RECURSIVE", 1)}, d AS (SELECT id, regexp_replace(regexp_replace(content, '[^\\x00-\\x7F]', 'x', 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM drawers),
walk(id, c, a, b) AS (SELECT id, c, 0, {_cut_sql("0")} FROM d WHERE c <> '' UNION ALL SELECT id, c, greatest(b - 100, 0), {_cut_sql("greatest(b - 100, 0)")} FROM walk WHERE b < length(c)),
p AS (SELECT id, a, regexp_replace(substr(c, a + 1, b - a), '^\\s+|\\s+$', '', 'g') AS t FROM walk)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY a) - 1 AS INTEGER) AS chunk_index, CAST(length(t) AS INTEGER) AS bytes, md5(t) AS md5 FROM p WHERE length(t) >= 50""",
    "chunk_paragraph": f"""{_D}, p AS (SELECT id, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls FROM drawers),
c AS (SELECT id, CASE WHEN len(ps) <= 1 AND len(ls) > 20 THEN list_transform(range(0, (len(ls) - 1) // 25 + 1), lambda g: regexp_replace(array_to_string(ls[g * 25 + 1 : g * 25 + 25], chr(10)), '^\\s+|\\s+$', '', 'g')) ELSE ps END AS cs FROM p),
e AS (SELECT id, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS chunk_index FROM c) SELECT id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(strlen(c) AS INTEGER) AS bytes FROM e WHERE strlen(c) > 30""",
    "chunk_exchange_plain": f"""{_MSG}, l AS (SELECT session, turn, trim(CASE WHEN role = 'user' THEN '> ' ELSE '' END || regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), '\\s+', ' ', 'g')) AS line FROM d),
g AS (SELECT *, sum(CAST(starts_with(line, '>') AS INTEGER)) OVER o AS part, sum(CAST(starts_with(line, '>') OR starts_with(line, '---') AS INTEGER)) OVER o AS block FROM l WINDOW o AS (PARTITION BY session ORDER BY turn)),
h AS (SELECT *, min(block) OVER (PARTITION BY session, part) AS head, row_number() OVER (PARTITION BY session, part ORDER BY turn) AS k FROM g),
b AS (SELECT session, part, max(line) FILTER (k = 1) AS question, coalesce(string_agg(line, ' ' ORDER BY turn) FILTER (k > 1 AND line <> ''), '') AS answer FROM h WHERE part > 0 AND block = head GROUP BY 1, 2),
w AS (SELECT session, part, CASE WHEN answer = '' THEN question ELSE question || chr(10) || answer END AS body FROM b),
c AS (SELECT session, part, i, substr(body, i * 800 + 1, 800) AS t FROM (SELECT *, unnest(range(0, (length(body) - 1) // 800 + 1)) AS i FROM w))
SELECT CAST(session AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY session ORDER BY part, i) - 1 AS INTEGER) AS chunk_index, md5(t) AS md5 FROM c WHERE i > 0 OR length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) > 30""",
    "convo_room": f"{_beside_sql(TALKS, True)}, r AS ({_ROOM}), b AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, place) AS k FROM r) SELECT i, CASE WHEN score > 0 THEN room ELSE 'general' END AS room FROM b WHERE k = 1",
    "exchange_pairs": f"{_MSG}, n AS (SELECT *, lead(role) OVER o AS nr, lead(text) OVER o AS nt FROM d WINDOW o AS (PARTITION BY session ORDER BY turn)) SELECT session, turn, text AS question, CASE WHEN nr = 'assistant' THEN nt END AS answer FROM n WHERE role = 'user'",
    "sweep_ids": f"{_MSG} SELECT 'sweep_' || session || '_' || uuid AS id, role FROM d",
    "sweep_new_only": f"{_MSG} SELECT 'sweep_' || session || '_' || uuid AS id FROM d WHERE turn >= 2",
    "themes_recent": f"""{_MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS k FROM d), w AS (SELECT session, lower(regexp_replace(unnest(regexp_split_to_array(text, '\\s+')), '^[^\\p{{L}}]+|[^\\p{{L}}]+$', '', 'g')) AS theme FROM r WHERE k <= 30),
c AS (SELECT session, theme, count(*) AS n FROM w WHERE strlen(theme) >= 4 AND regexp_full_match(theme, '\\p{{L}}+') AND theme NOT IN ({', '.join(f"'{x}'" for x in messages.NO_THEMES)}) GROUP BY 1, 2)
SELECT * FROM (SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY n DESC, theme) AS INTEGER) AS rank, theme, n FROM c) WHERE rank <= 3""",
    "session_saves": "SELECT conv_id AS session, count(*) // 15 AS saves FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "slack_roles": "WITH f AS (SELECT c_nationkey AS chat, o_custkey AS speaker, min(o_orderkey) AS place FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT chat, speaker, CASE WHEN row_number() OVER (PARTITION BY chat ORDER BY place) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role FROM f",
    "file_room": f"""{_D}, f AS (SELECT doc_id, {_PICK(FOLDERS, 1)} AS folder, {_PICK(STEMS, 6)} AS stem, lower(substr({_PICK(WORDS, 24)} || ' ' || content, 1, 2000)) AS low FROM drawers),
c AS (SELECT *, {_COUNT("ui")} + {_COUNT("react")} + {_COUNT("frontend")} AS a, {_COUNT("api")} + {_COUNT("server")} + {_COUNT("backend")} AS b, {_COUNT("docs")} AS d FROM f)
SELECT doc_id, CASE WHEN folder IN ('src/frontend-app', 'ui') THEN 'frontend' WHEN folder = 'lib/api' THEN 'backend' WHEN folder = 'Docs' OR stem = 'docs' THEN 'docs'
  WHEN greatest(a, b, d) = 0 THEN 'general' WHEN a >= greatest(b, d) THEN 'frontend' WHEN b >= d THEN 'backend' ELSE 'docs' END AS room FROM c""",
    "fact_issues": """WITH c AS (SELECT c_custkey AS i, 'C' || c_custkey AS subject, 'Nation' || c_nationkey AS object, CASE WHEN c_custkey % 2 = 0 THEN 'client' ELSE 'friend' END AS known,
  CASE WHEN c_custkey % 3 = 0 THEN '2020-01-01' WHEN c_custkey % 5 = 0 THEN '2030-01-01' END AS valid_to FROM customer), p AS (SELECT *, unnest(['client', 'friend']) AS predicate FROM c),
k AS (SELECT *, CASE WHEN valid_to IS NULL AND known <> predicate THEN 'relationship_mismatch' WHEN known = predicate AND valid_to < '2024-01-01' THEN 'stale_fact' END AS kind FROM p)
SELECT i, subject, predicate, object, kind, known, valid_to FROM k WHERE kind IS NOT NULL""",
    "corpus_origin": f"""{_D}, t AS (SELECT wing || '/' || room AS corpus, content || chr(10) || {_ARRAY(BRANDED)}[(length(room) + length(wing) + ascii(room[1]) + ascii(wing[-1])) % {len(BRANDED)} + 1] AS text FROM drawers),
s AS (SELECT corpus, sum(strlen(text)) + 2 * (count(*) - 1) AS b, sum({_N('text', [_TERM(x) for x in origin.SURE_TERMS])}) AS sure, sum({_N('text', [_TERM(x) for x in origin.AMBIGUOUS_TERMS])}) AS maybe, CAST(sum({_N('text', [f'(?i){x}' for x in origin.TURN_MARKS])}) AS BIGINT) AS turns FROM t GROUP BY corpus),
h AS (SELECT *, CAST(sure + CASE WHEN sure > 0 OR turns > 0 THEN maybe ELSE 0 END AS BIGINT) AS brands FROM s), d AS (SELECT *, brands / (greatest(b, 1) / 1000.0) AS bd, turns / (greatest(b, 1) / 1000.0) AS td FROM h)
SELECT corpus, brands, turns, bd >= {origin.BRAND_DENSITY} OR td >= {origin.TURN_DENSITY} OR NOT (brands = 0 AND turns = 0 AND b >= {origin.FLOOR}) AS ai_dialogue,
  round(CAST(CASE WHEN bd >= {origin.BRAND_DENSITY} OR td >= {origin.TURN_DENSITY} THEN least(0.95, 0.6 + 0.1 * (bd + td)) WHEN brands = 0 AND turns = 0 AND b >= {origin.FLOOR} THEN 0.9 ELSE 0.4 END AS DOUBLE), 6) AS confidence FROM d""",
    "query_sanitizer": f"""WITH {M.MESSAGES}, q AS (SELECT uuid AS i, coalesce(text, '') || chr(10) || {_ARRAY(ASKED)}[(session * 3 + turn) % {len(ASKED)} + 1] AS raw FROM messages),
t AS (SELECT i, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text, list_filter(list_transform(regexp_split_to_array(raw, '\\r?\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[-1] AS last FROM q)
SELECT i, CASE WHEN length(text) <= 200 THEN text WHEN length(last) >= 3 THEN right(last, 250) ELSE right(text, 250) END AS query,
  CASE WHEN length(text) <= 200 THEN 'passthrough' WHEN length(last) >= 3 AND regexp_matches(last, '[?？]\\s*["'']?\\s*$') THEN 'question_extraction' WHEN length(last) >= 3 THEN 'tail_sentence' ELSE 'tail_truncation' END AS method FROM t""",
    "similar_names": f"""WITH {M.PART_NAMES}, t AS (SELECT p_partkey AS i, ' ' || lower('one ' || label || ' of ' || p_name || ' here') || ' ' AS text FROM part_names),
n AS (SELECT DISTINCT unnest([p_name, label]) AS name FROM part_names), near AS (SELECT a.name, b.name AS other, levenshtein(lower(a.name), lower(b.name)) AS distance FROM n a, n b WHERE levenshtein(lower(a.name), lower(b.name)) BETWEEN 1 AND 2),
h AS (SELECT i, name FROM t, n WHERE contains(text, ' ' || lower(name) || ' '))
SELECT h.i, h.name, near.other, CAST(near.distance AS INTEGER) AS distance FROM h JOIN near USING (name) WHERE NOT EXISTS (SELECT 1 FROM h o WHERE o.i = h.i AND o.name = near.other)""",
    "near_names_of_tables": f"""WITH {M.PART_NAMES}, n AS (SELECT DISTINCT name FROM (SELECT unnest([p_name, label]) AS name FROM part_names UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier))
SELECT a.name, b.name AS other, CAST(levenshtein(lower(a.name), lower(b.name)) AS INTEGER) AS distance FROM n a, n b WHERE abs(length(a.name) - length(b.name)) <= 2 AND levenshtein(lower(a.name), lower(b.name)) BETWEEN 1 AND 2""",
    "entity_candidates": f"{_D}, told AS (SELECT id, content AS text FROM drawers), {_CANDIDATES} SELECT name, n FROM names",
    "entity_scores": f"WITH {M.DRAWERS}, {M.MESSAGES}, {_TOLD}, {_CANDIDATES}, {_SIGNALS} SELECT name, n, person, kinds, project FROM scored",
    "entity_class": f"""WITH {M.DRAWERS}, {M.MESSAGES}, {_TOLD}, {_CANDIDATES}, {_SIGNALS},
c AS (SELECT *, person / greatest(person + project, 1) AS ratio, person / greatest(person + project, 1) >= 0.7 AND kinds >= 2 AND person >= 5 AS sure FROM scored),
k AS (SELECT name, n, CASE WHEN person + project = 0 THEN 'uncertain' WHEN sure THEN 'person' WHEN ratio >= 0.7 THEN 'uncertain' WHEN ratio <= 0.3 THEN 'project' ELSE 'uncertain' END AS kind,
  CASE WHEN person + project = 0 THEN least(0.4, n / 50) WHEN sure THEN least(0.99, 0.5 + ratio * 0.5) WHEN ratio >= 0.7 THEN 0.4 WHEN ratio <= 0.3 THEN least(0.99, 0.5 + (1 - ratio) * 0.5) ELSE 0.5 END AS confidence FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, n DESC, name) AS rank FROM k)
SELECT name, n, kind, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM r WHERE rank <= CASE kind WHEN 'person' THEN 15 WHEN 'project' THEN 10 ELSE 8 END""",
    "documents_origin": f"""{_D}, c AS (SELECT wing AS corpus, sum(strlen(content)) + 2 * (count(*) - 1) AS b, CAST(sum({_N('content', [f'(?i){p}' for p in origin.TURN_MARKS])}) AS BIGINT) AS turns FROM drawers GROUP BY wing)
SELECT corpus, CAST(0 AS BIGINT) AS brands, turns, NOT b >= 150 AS ai_dialogue, CAST(CASE WHEN b >= 150 THEN 0.9 ELSE 0.4 END AS DOUBLE) AS confidence FROM c""",
}
_CODES = f"list_transform(list_filter(list_transform(list_slice(regexp_split_to_array(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), '\\s+'), 2, 1000000000), lambda w: regexp_replace(w, '[^a-zA-Z]', '', 'g')), lambda w: regexp_full_match(w, '[A-Z][a-z]+') AND lower(w) NOT IN ({', '.join(f"'{x}'" for x in dialect.NO_TOPICS)})), lambda w: upper(w[1:3]))"
_LINES = f"""{_D}, tp AS (SELECT id, string_agg(topic, '_' ORDER BY rank) AS topics FROM ({ORACLE_SQL["topics_top3"]}) GROUP BY id), ks AS ({ORACLE_SQL["key_sentence"]}),
e AS (SELECT id, doc_id, wing, room, filed_at, content, content AS text, {_CODES} AS e FROM drawers),
c AS MATERIALIZED (SELECT id, doc_id, wing, room, filed_at, content, array_to_string(list_slice(list_filter(e, lambda x, i: list_position(e, x) = i), 1, 3), '+') AS codes, replace({_DISTINCT3(_FIRST(dialect.MOODS))}, ',', '+') AS moods, replace({_DISTINCT3(_FIRST([(w, f) for f, ws in dialect.FLAGS for w in ws]))}, ',', '+') AS flags FROM e),
lines AS MATERIALIZED (SELECT id, doc_id, wing, room, filed_at, content, sentence, codes, topics, moods, flags, concat_ws('|', '0:' || CASE WHEN codes = '' THEN '???' ELSE codes END, coalesce(topics, 'misc'), CASE WHEN sentence <> '' THEN '"' || sentence || '"' END, nullif(moods, ''), nullif(flags, '')) AS line FROM c LEFT JOIN tp USING (id) JOIN ks USING (id))"""
ORACLE_SQL["compress_lines"] = f"{_LINES} SELECT id, line, round(strlen(line) / greatest(strlen(content), 1), 6) AS ratio FROM lines"
ORACLE_SQL["line_round_trip"] = f"""{_LINES} SELECT d.id, d.wing || CASE WHEN d.doc_id % 4 = 0 THEN '|50%' || chr(10) || '%7C' ELSE '' END AS wing, CASE WHEN d.doc_id % 3 = 0 THEN '?' ELSE d.room END AS room, strftime(d.filed_at, '%Y-%m-%d') AS date,
  CAST(d.doc_id // 1000 AS VARCHAR) AS stem, replace(codes, '+', ',') AS entities, coalesce(array_to_string(string_split(topics, '_'), ','), '') AS topics, sentence, replace(moods, '+', ',') AS moods, replace(flags, '+', ',') AS flags FROM lines d"""
ORACLE_SQL["compress_totals"] = f"{_LINES} SELECT CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(sum(strlen(line)) AS BIGINT) AS compressed FROM lines"
QUERIES = {f.__name__: f for f in (memory_types, emotions_flags, topics_top3, key_sentence, token_estimates, compress_lines, line_round_trip, compress_totals, chunk_text, chunk_text_plain, chunk_paragraph, chunk_exchange, chunk_exchange_plain, convo_room, file_room, exchange_pairs, sweep_ids, sweep_new_only, themes_recent, session_saves, slack_roles, entity_candidates, entity_scores, entity_class, fact_issues, similar_names, near_names_of_tables, corpus_origin, documents_origin, query_sanitizer)}
