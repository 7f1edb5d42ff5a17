"""Diaries and message streams through their ingest operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators import diary, messages
from tessera.operators.store import Store
from tessera.plans import model as M
from tessera.runtime import new_path
from tessera.sources import ignore
from tessera.sources.sample import detection_sample
from tessera.streaming.ingest import message_stream, sweep_into

WING, AGENT = "wing_test diary", "scribe"


def _diaries(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each conversation, a section for each message, under a date of January by its id."""
    rows = messages.dialogue(M.messages(spark, sf))
    part = F.concat(F.lit("## "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text", F.lit("\n"))
    day = F.lpad((F.pmod("session", F.lit(28)) + 1).cast("string"), 2, "0")
    path = F.concat(F.lit("diary/2024-01-"), day, F.lit("-"), F.col("session").cast("string"), F.lit(".md"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "")
    return rows.groupBy("session").agg(whole.alias("content")).select("session", path.alias("path"), F.octet_length("content").cast("long").alias("bytes"), F.lit(1.0).alias("mtime"), "content")


def diary_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of diaries of which one in three is known and unchanged and one in three was rebuilt."""
    files = _diaries(spark, sf)
    known = files.filter("session % 3 <> 0").withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    state = known.select("path", F.when(F.col("session") % 3 == 1, F.col("hash")).otherwise("old").alias("hash"), "bytes", "mtime", F.lit(1).alias("entries"))
    return diary.entries(diary.decisions(files.drop("session"), state), WING, AGENT).select("id", "source_file", "chunk_index", "content")


def stream_sweep_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Messages that come twice, as a stream of files, each stored once."""
    path = new_path(spark, "message-stream")
    rows = M.messages(spark, sf)
    for _ in range(2):
        rows.write.mode("append").parquet(path)
    store = Store(spark, new_path(spark, "swept"))
    sweep_into(message_stream(spark, path, rows.schema), store.add_drawers, new_path(spark, "sweep-checkpoint")).awaitTermination()
    return store.read("drawers").select("id", "content")


#: Lines of the ignore files at the top, of each source and of its tmp folder.
TOP = "# build output\n*.log\n!keep_*.log\n/src1/tmp/\n"
OF_SOURCE = "cache/**/f*.py\n\ndocs/*/*.md\n!docs/en/*.md\n!*5.log\n"
OF_TMP = "*\n!*.md\n!*/\n"


def ignored_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of a file for each document, with ignore files at three levels: what stays."""
    d = M.table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("xx")).alias("lang"))
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("doc_id") % n + 1).cast("int"))
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, "keep_").otherwise(""), F.lit("f"), F.col("doc_id"), pick(3, ".md", ".log", ".py"))
    paths = d.select("doc_id", F.concat_ws("/", "source", pick(4, "src", "tmp", "docs", "cache/deep"), "lang", name).alias("path"))
    sources = d.select("source").distinct()
    files = sources.select(F.col("source").alias("folder"), F.lit(OF_SOURCE).alias("content")).unionAll(sources.select(F.concat("source", F.lit("/tmp")), F.lit(OF_TMP)))
    top = d.select(F.lit("").alias("folder"), F.lit(TOP).alias("content")).distinct()
    return ignore.kept(paths, files.unionAll(top))


def detection_files(spark: SparkSession, sf: str) -> DataFrame:
    """What is read of each source and language as a project; some have little prose."""
    name = F.concat(F.lit("f"), F.col("doc_id"), F.when((F.col("doc_id") % 9 == 0) | F.col("room").isin("en", "fr"), ".md").when(F.col("doc_id") % 5 == 0, ".log").otherwise(".py"))
    d = M.drawers(spark, sf).select(F.concat_ws("/", "wing", "room").alias("project"), name.alias("path"), F.regexp_replace("content", r"[^\x00-\x7F]", "x").alias("content"))
    return detection_sample(d, 8, 2000, 9000).select("project", "path", "place", F.md5(F.col("content").cast("binary")).alias("md5"))


_RULES = """('top', 1, false, false, '^(.*/)?[^/]*[.]log$'), ('top', 2, true, false, '^(.*/)?keep_[^/]*[.]log$'), ('top', 3, false, true, '^src1/tmp$'),
('source', 0, false, false, '^cache/(.*/)?f[^/]*[.]py$'), ('source', 2, false, false, '^docs/[^/]*/[^/]*[.]md$'), ('source', 3, true, false, '^docs/en/[^/]*[.]md$'), ('source', 4, true, false, '^(.*/)?[^/]*5[.]log$'),
('tmp', 0, false, false, '^(.*/)?[^/]*$'), ('tmp', 1, true, false, '^(.*/)?[^/]*[.]md$'), ('tmp', 2, true, true, '^(.*/)?[^/]*$')"""
_MSG = f"WITH {M.MESSAGES}, d AS (SELECT * FROM messages WHERE role IN ('user', 'assistant') AND trim(text) <> '')"
_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
ORACLE_SQL = {
    "detection_files": f"""WITH {M.DRAWERS}, d AS (SELECT wing || '/' || room AS project, 'f' || doc_id || CASE WHEN doc_id % 9 = 0 OR room IN ('en', 'fr') THEN '.md' WHEN doc_id % 5 = 0 THEN '.log' ELSE '.py' END AS path, substr(regexp_replace(content, '[^\\x00-\\x7F]', 'x', 'g'), 1, 2000) AS content FROM drawers),
k AS (SELECT *, CAST(path LIKE '%.py' AS INTEGER) AS kind, count(*) FILTER (path LIKE '%.md') OVER (PARTITION BY project) AS prose FROM d WHERE path NOT LIKE '%.log'),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY kind, path) AS INTEGER) AS place FROM k WHERE kind = 0 OR prose < 5),
b AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY project ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WHERE place <= 8)
SELECT project, path, place, md5(content) AS md5 FROM b WHERE before < 9000""",
    "ignored_paths": f"""WITH r(level, line, keep, folders_only, pattern) AS (VALUES {_RULES}),
f AS (SELECT doc_id, coalesce(source, 'none') || '/' || ['src', 'tmp', 'docs', 'cache/deep'][doc_id % 4 + 1] || '/' || coalesce(lang, 'xx') || '/' || CASE WHEN doc_id % 7 = 0 THEN 'keep_' ELSE '' END || 'f' || doc_id || ['.md', '.log', '.py'][doc_id % 3 + 1] AS path FROM documents),
e AS (SELECT doc_id, path, p, unnest(range(1, len(p) + 1)) AS n FROM (SELECT doc_id, path, string_split(path, '/') AS p FROM f)),
m AS (SELECT e.doc_id, n, r.level, r.line, r.keep FROM e, r WHERE (n < len(p) OR NOT folders_only) AND CASE level WHEN 'top' THEN regexp_matches(array_to_string(p[1:n], '/'), pattern)
  WHEN 'source' THEN n > 1 AND regexp_matches(array_to_string(p[2:n], '/'), pattern) ELSE n > 2 AND p[2] = 'tmp' AND regexp_matches(array_to_string(p[3:n], '/'), pattern) END),
v AS (SELECT doc_id, n, arg_max(keep, CASE level WHEN 'top' THEN 0 WHEN 'source' THEN 100 ELSE 200 END + line) AS keep FROM m GROUP BY 1, 2)
SELECT doc_id, path FROM f WHERE doc_id NOT IN (SELECT doc_id FROM v WHERE NOT keep)""",
    "diary_sections": f"""{_MSG}, f AS (SELECT *, 'diary/2024-01-' || lpad(CAST(session % 28 + 1 AS VARCHAR), 2, '0') || '-' || session || '.md' AS path, CAST(row_number() OVER (PARTITION BY session ORDER BY turn) - 1 AS INTEGER) AS n FROM d)
SELECT 'diary-wing_test_diary-' || substr(sha256('{WING}' || chr(0) || '{AGENT}' || chr(0) || path), 1, 8) || '-' || substr(path, 7, 10) || '-' || n AS id, path AS source_file, n AS chunk_index, '## ' || role || ' ' || turn || chr(10) || {_TRIM} AS content FROM f WHERE session % 3 <> 1""",
    "stream_sweep_dedup": f"{_MSG} SELECT 'sweep_' || session || '_' || uuid AS id, text AS content FROM d",
}
QUERIES = {f.__name__: f for f in (diary_sections, stream_sweep_dedup, ignored_paths, detection_files)}
