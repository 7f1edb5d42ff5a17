"""Queries over the index and the drawers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.text import content_id, query_tokens, tunnel_id
from tessera.operators import browse, index, layers, search
from tessera.plans import model as M

QUERY = "thatin rewh orre"
TWICE = "thatin rewh thatin orre orre"


def _search(spark: SparkSession, sf: str, query: str, n: int = 10, **where) -> DataFrame:
    found = M.search_index(spark, sf).search(query, n, **where)
    return found.select("id", "wing", "room", "chunk_index", M.rounded(F.col("relevance")).alias("relevance"))


def _search_sql(query: str, n: int = 10, where: str = "", tail: str = "SELECT id, wing, room, chunk_index, round(relevance, 6) AS relevance FROM best") -> str:
    words = query_tokens(query)
    asked = ", ".join(f"('{w}', {words.count(w)})" for w in dict.fromkeys(words))
    return f"""WITH {M.WORDS}, asked(word, k) AS (VALUES {asked}),
pool AS (SELECT d.*, c.tf FROM (SELECT id, sum(n) AS tf FROM words WHERE word IN (SELECT word FROM asked) GROUP BY id) c
  JOIN drawers d USING (id) WHERE d.content <> '' {where} ORDER BY c.tf DESC, d.id LIMIT {3 * n}),
len AS (SELECT id, sum(n) AS length FROM words WHERE id IN (SELECT id FROM pool) GROUP BY id),
facts AS (SELECT count(*) AS total, avg(length) AS avgdl FROM pool JOIN len USING (id)),
terms AS (SELECT w.* FROM words w WHERE w.id IN (SELECT id FROM pool) AND w.word IN (SELECT word FROM asked)),
df AS (SELECT word, count(*) AS df FROM terms GROUP BY word),
scores AS (SELECT t.id, sum(a.k * ln((f.total - df.df + 0.5) / (df.df + 0.5) + 1) * t.n * 2.5 / (t.n + 1.5 * (1 - 0.75 + 0.75 * l.length / f.avgdl))) AS relevance
  FROM terms t JOIN asked a USING (word) JOIN df USING (word) JOIN len l ON l.id = t.id CROSS JOIN facts f GROUP BY t.id),
best AS (SELECT p.*, s.relevance FROM pool p JOIN scores s USING (id) ORDER BY s.relevance DESC, p.id LIMIT {n})
{tail}"""


def bm25_search(spark, sf):
    return _search(spark, sf, QUERY)


def bm25_search_wing(spark, sf):
    return _search(spark, sf, QUERY, wing="src3")


def bm25_search_repeated_terms(spark, sf):
    return _search(spark, sf, TWICE)


def bm25_closet_boost(spark, sf):
    index = M.search_index(spark, sf)
    found = index.search(QUERY, 10)
    closets = index.files_of(found).select("source_file", "content")
    up = search.boosted(found, search.closet_boosts(found, closets, query_tokens(QUERY)))
    return up.select("id", "source_file", M.rounded(F.col("relevance")).alias("relevance"))


_HITS = " + ".join(f"CAST(contains(lower(content), '{w}') AS INTEGER)" for w in query_tokens(QUERY))
_BOOST = f"""SELECT b.id, b.source_file, round(b.relevance * (1 + coalesce(k.boost, 0)), 6) AS relevance FROM best b LEFT JOIN (
  SELECT source_file, CASE row_number() OVER (ORDER BY hits DESC, source_file) WHEN 1 THEN 0.4 WHEN 2 THEN 0.25 WHEN 3 THEN 0.15 WHEN 4 THEN 0.08 WHEN 5 THEN 0.04 ELSE 0.02 END AS boost
  FROM (SELECT source_file, max({_HITS}) AS hits FROM drawers WHERE content <> '' AND source_file IN (SELECT source_file FROM best) GROUP BY source_file) WHERE hits > 0) k USING (source_file)"""


def neighbor_chunks(spark, sf):
    index = M.search_index(spark, sf)
    return index.neighbours(index.search(QUERY, 10), 2).select("anchor", "id", "chunk_index")


_NEIGHBOURS = "SELECT b.id AS anchor, d.id, d.chunk_index FROM best b JOIN drawers d ON d.source_file = b.source_file AND d.chunk_index BETWEEN b.chunk_index - 2 AND b.chunk_index + 2 AND d.chunk_index <> b.chunk_index"
CONTENT = "The thatin was rewh and orre with eronti"


def check_duplicate(spark, sf):
    found = M.search_index(spark, sf).check_duplicate(CONTENT)
    return found.select("id", M.rounded(F.col("relevance")).alias("relevance"))


def build_postings(spark, sf):
    return M.postings(spark, sf)


def doc_lengths(spark, sf):
    return M.search_index(spark, sf).doc_lengths()


def index_integrity(spark, sf):
    """The index of everything but diaries, with postings of drawers that are gone."""
    d = M.drawers(spark, sf)
    lost = M.stored_postings(spark, sf).join(d.filter("ingest_mode = 'diary'").select("id"), "id", "left_anti")
    stale = d.filter("ingest_mode = 'convos'").select(F.lit("gone").alias("word"), F.concat(F.lit("old_"), F.col("id")).alias("id"), F.lit(1).cast("long").alias("n"))
    return index.integrity(d, lost.unionByName(stale))


def taxonomy(spark, sf):
    return browse.taxonomy(M.drawers(spark, sf))


def taxonomy_rollup(spark, sf):
    return browse.taxonomy_rollup(M.drawers(spark, sf))


def store_stats(spark, sf):
    return browse.statistics(M.drawers(spark, sf), M.entities(spark, sf), M.triples(spark, sf))


def list_drawers_page(spark, sf):
    return browse.page(M.drawers(spark, sf), 20, 10)


def diary_read(spark, sf):
    return browse.diary(M.drawers(spark, sf), "agent1", 10).select("id", "wing", "room", "content")


def browse_recent(spark, sf):
    return browse.recent(M.drawers(spark, sf), 15, wing="src3")


def l1_budget(spark, sf):
    return browse.essential_story(M.drawers(spark, sf))


def story_facts(spark, sf):
    return layers.fact_lines(M.triples(spark, sf), M.entities(spark, sf), 200)


def wake_story(spark, sf):
    """The story of a wing with few words in its first drawers, and facts below it."""
    d = M.drawers(spark, sf).filter("wing = 'src3'").withColumn("content", F.substring("content", 1, 40))
    return layers.wake_story(d, M.triples(spark, sf), M.entities(spark, sf))


def l3_neighbours(spark, sf):
    return layers.deep_search(M.search_index(spark, sf), QUERY, 5)


def file_freshness(spark, sf):
    rows = M.drawers(spark, sf).select("source_file", F.when(F.col("room") == "es", None).when((F.col("room") == "fr") & (F.col("ingest_mode") == "convos"), -1.0).when(F.col("room") == "de", F.col("chunk_index").cast("double")).otherwise(1000.0).alias("source_mtime"))
    return browse.file_freshness(rows)


def export_groups(spark, sf):
    return browse.export_groups(M.drawers(spark, sf))


def content_ids(spark, sf):
    return M.drawers(spark, sf).select("id", content_id(F.col("wing"), F.col("room"), F.col("content")).alias("content_id"))


def tunnel_ids(spark, sf):
    g = M.graph_drawers(spark, sf)
    return g.select("id", tunnel_id(F.col("wing"), F.col("room"), F.lit("w1"), F.col("room")).alias("tunnel"), tunnel_id(F.lit("w1"), F.col("room"), F.col("wing"), F.col("room")).alias("back"))


def sync_buckets(spark, sf):
    d = M.drawers(spark, sf).withColumn("source_file", F.when(F.col("ingest_mode") == "diary", "").otherwise(F.col("source_file")))
    roots = spark.createDataFrame([("/corpus/src1",), ("/corpus/src2/",), ("/corpus",), ("/corpus/src3/de",)], "root string").filter("root <> '/corpus'")
    present = d.filter("room <> 'fr'").select("source_file")
    ignored = d.filter("wing = 'src2' and room = 'de'").select("source_file")
    return browse.sync_buckets(d, roots, present, ignored).groupBy("bucket").agg(F.count("*").alias("n"))


_D = f"WITH {M.DRAWERS}"
_FACTS = """fp AS (SELECT DISTINCT s.name, t.predicate, t.subject FROM triples t JOIN entities s ON s.id = t.subject WHERE t.valid_to IS NULL ORDER BY 1, 2, 3 LIMIT 20),
fl AS (SELECT p.name, p.predicate, p.subject, row_number() OVER (PARTITION BY p.subject, p.predicate ORDER BY o.name, t.id) AS k, '  - ' || p.name || ' ' || p.predicate || ' ' || o.name AS line
  FROM fp p JOIN triples t ON t.subject = p.subject AND t.predicate = p.predicate JOIN entities o ON o.id = t.object UNION ALL SELECT '', '', '', 0, chr(10) || '[knowledge graph]'),
fr AS (SELECT CAST(row_number() OVER o AS INTEGER) AS position, line, sum(strlen(line)) OVER (o ROWS UNBOUNDED PRECEDING) AS used FROM fl WINDOW o AS (ORDER BY name, predicate, subject, k))"""
_SNIPPET = "replace(substr(content, 1, 300), chr(10), ' ')"
ORACLE_SQL = {
    "bm25_search": _search_sql(QUERY),
    "bm25_search_wing": _search_sql(QUERY, where="AND d.wing = 'src3'"),
    "bm25_search_repeated_terms": _search_sql(TWICE),
    "bm25_closet_boost": _search_sql(QUERY, tail=_BOOST),
    "neighbor_chunks": _search_sql(QUERY, tail=_NEIGHBOURS),
    "check_duplicate": _search_sql(CONTENT, 5, tail="SELECT id, round(relevance, 6) AS relevance FROM best WHERE relevance > 3"),
    "build_postings": f"WITH {M.WORDS} SELECT word, id, n FROM words",
    "doc_lengths": f"WITH {M.WORDS} SELECT id, CAST(sum(n) AS BIGINT) AS length FROM words GROUP BY id",
    "index_integrity": f"""WITH {M.WORDS} SELECT 'unindexed' AS problem, id FROM drawers WHERE ingest_mode = 'diary' AND id IN (SELECT id FROM words)
UNION ALL SELECT 'orphan', 'old_' || id FROM drawers WHERE ingest_mode = 'convos'""",
    "taxonomy": f"{_D} SELECT wing, room, count(*) AS n FROM drawers GROUP BY ALL",
    "taxonomy_rollup": f"{_D} SELECT wing, room, count(*) AS n, CAST(grouping_id(wing, room) AS INTEGER) AS level FROM drawers GROUP BY ROLLUP (wing, room)",
    "store_stats": f"{_D}, {M.KG} SELECT (SELECT count(*) FROM drawers) AS drawers, (SELECT count(DISTINCT wing) FROM drawers) AS wings, (SELECT count(*) FROM (SELECT DISTINCT wing, room FROM drawers)) AS rooms, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM triples) AS triples",
    "list_drawers_page": f"{_D} SELECT id, wing, room, substr(content, 1, 200) || CASE WHEN length(content) > 200 THEN '...' ELSE '' END AS preview FROM drawers WHERE ingest_mode IS NULL OR ingest_mode <> 'diary' ORDER BY filed_at DESC, id DESC LIMIT 20 OFFSET 10",
    "diary_read": f"{_D} SELECT id, wing, room, content FROM drawers WHERE ingest_mode = 'diary' AND added_by = 'agent1' ORDER BY filed_at DESC, id DESC LIMIT 10",
    "browse_recent": f"{_D} SELECT id, wing, room, substr(content, 1, 300) || CASE WHEN strlen(content) > 300 THEN '...' ELSE '' END AS snippet, string_split(source_file, '/')[-1] AS source_name FROM drawers WHERE wing = 'src3' ORDER BY filed_at DESC, id LIMIT 15",
    "l1_budget": f"""{_D}, first AS (SELECT * FROM drawers ORDER BY filed_at, id LIMIT 15),
lines AS (SELECT room, filed_at, id, '  - ' || replace(substr(content, 1, 200), chr(10), ' ') || CASE WHEN strlen(content) > 200 THEN '...' ELSE '' END || '  (' || string_split(source_file, '/')[-1] || ')' AS line FROM first
  UNION ALL SELECT DISTINCT room, CAST(NULL AS TIMESTAMP), '', chr(10) || '[' || room || ']' FROM first),
run AS (SELECT CAST(row_number() OVER o AS INTEGER) AS position, line, filed_at IS NULL AS head, sum(strlen(line)) OVER (o ROWS UNBOUNDED PRECEDING) > 3200 AS over FROM lines WINDOW o AS (ORDER BY room, filed_at NULLS FIRST, id)),
cut AS (SELECT min(position) AS cut FROM run WHERE over AND NOT head)
SELECT position, line FROM run, cut WHERE cut IS NULL OR position < cut UNION ALL SELECT cut, '  ... (more in L3 search)' FROM cut WHERE cut IS NOT NULL""",
    "story_facts": f"WITH {M.KG}, {_FACTS} SELECT position, line FROM fr WHERE used + 200 <= 3200",
    "wake_story": f"""{_D}, {M.KG}, {_FACTS}, d AS (SELECT *, substr(content, 1, 40) AS short FROM drawers WHERE wing = 'src3'), first AS (SELECT * FROM d ORDER BY filed_at, id LIMIT 15),
lines AS (SELECT room, filed_at, id, '  - ' || replace(short, chr(10), ' ') || '  (' || string_split(source_file, '/')[-1] || ')' AS line FROM first UNION ALL SELECT DISTINCT room, CAST(NULL AS TIMESTAMP), '', chr(10) || '[' || room || ']' FROM first),
story AS (SELECT CAST(row_number() OVER (ORDER BY room, filed_at NULLS FIRST, id) AS INTEGER) AS position, line FROM lines)
SELECT 1 AS part, position, line FROM story UNION ALL SELECT 2, position, line FROM fr WHERE used + (SELECT sum(strlen(line)) FROM story) <= 3200""",
    "l3_neighbours": _search_sql(QUERY, 5, tail=f""", k AS (SELECT *, row_number() OVER (ORDER BY relevance DESC, id) AS rank FROM best),
near AS (SELECT d.chunk_index, d.content FROM k JOIN drawers d ON k.rank = 1 AND d.source_file = k.source_file AND d.chunk_index BETWEEN k.chunk_index - 2 AND k.chunk_index + 2 AND d.chunk_index <> k.chunk_index),
l AS (SELECT rank, 0 AS j, printf('  [%d] %s/%s (score=%.1f, chunk=%d)', rank, wing, room, relevance, chunk_index) AS line FROM k
  UNION ALL SELECT rank, 1, '      ' || {_SNIPPET} || CASE WHEN strlen(content) > 300 THEN '...' ELSE '' END FROM k UNION ALL SELECT rank, 2, '      src: ' || source_file FROM k
  UNION ALL SELECT 1000, 0, '      nearby context:' FROM near WHERE chunk_index = (SELECT min(chunk_index) FROM near) UNION ALL SELECT 1000, chunk_index + 1, '        chunk ' || chunk_index || ': ' || {_SNIPPET} FROM near)
SELECT CAST(row_number() OVER (ORDER BY rank, j) AS INTEGER) AS position, line FROM l"""),
    "file_freshness": f"""{_D}, m AS (SELECT source_file, CASE WHEN room = 'es' THEN NULL WHEN room = 'fr' AND ingest_mode = 'convos' THEN -1.0 WHEN room = 'de' THEN CAST(chunk_index AS DOUBLE) ELSE 1000.0 END AS t FROM drawers)
SELECT source_file, CASE WHEN count(*) FILTER (t IS NULL OR t < 0) = 0 AND min(t) = max(t) THEN min(t) END AS mtime, count(*) AS n FROM m GROUP BY source_file""",
    "export_groups": f"{_D} SELECT wing, room, wing || '/' || room || '.md' AS file, count(*) AS n, CAST(sum(strlen(content)) AS BIGINT) AS bytes, min(id) AS first_id FROM drawers WHERE content <> '' GROUP BY wing, room",
    "content_ids": f"{_D} SELECT id, 'drawer_' || wing || '_' || room || '_' || substr(sha256(wing || chr(31) || room || chr(31) || content), 1, 24) AS content_id FROM drawers",
    "tunnel_ids": f"WITH {M.GRAPH}, e AS (SELECT id, wing || '/' || room AS a, 'w1/' || room AS b FROM graph_drawers), t AS (SELECT id, substr(sha256(least(a, b) || '↔' || greatest(a, b)), 1, 16) AS tunnel FROM e) SELECT id, tunnel, tunnel AS back FROM t",
    "sync_buckets": f"""{_D} SELECT CASE WHEN ingest_mode = 'diary' THEN 'no_source'
  WHEN NOT (source_file LIKE '/corpus/src1/%' OR source_file LIKE '/corpus/src2/%' OR source_file LIKE '/corpus/src3/de/%') THEN 'out_of_scope'
  WHEN room = 'fr' THEN 'missing' WHEN wing = 'src2' AND room = 'de' THEN 'gitignored' ELSE 'kept' END AS bucket, count(*) AS n FROM drawers GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (bm25_search, bm25_search_wing, bm25_search_repeated_terms, bm25_closet_boost, neighbor_chunks, check_duplicate, build_postings, doc_lengths, index_integrity, taxonomy, taxonomy_rollup, store_stats, list_drawers_page, diary_read, browse_recent, l1_budget, story_facts, wake_story, l3_neighbours, file_freshness, export_groups, content_ids, tunnel_ids, sync_buckets)}
