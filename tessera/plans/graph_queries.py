"""Queries over facts, rooms, links and similar drawers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dedup, graph, kg
from tessera.plans import model as M

NAME, DAY = "customer_7", "1998-03-15"


def kg_outgoing(spark, sf):
    return kg.facts(M.triples(spark, sf), M.entities(spark, sf), NAME, "outgoing")


def kg_incoming(spark, sf):
    return kg.facts(M.triples(spark, sf), M.entities(spark, sf), "Nation 7", "incoming")


def kg_both(spark, sf):
    return kg.facts(M.triples(spark, sf), M.entities(spark, sf), "nation_7", "both")


def kg_as_of(spark, sf):
    return kg.facts(M.triples(spark, sf), M.entities(spark, sf), NAME, "outgoing", DAY)


def kg_as_of_all(spark, sf):
    """Facts that hold on a day, by predicate, over all entities."""
    return M.triples(spark, sf).filter(kg.valid_at(DAY)).groupBy("predicate").agg(F.count("*").alias("n"))


def kg_as_of_many(spark, sf):
    """What holds for the customer of each order ten days after it, at noon for every third."""
    day = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 10), "yyyy-MM-dd")
    at = F.when(F.col("o_orderkey") % 3 == 0, F.concat(day, F.lit("T12:00:00+00:00"))).otherwise(day)
    asked = M.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("customer_"), F.col("o_custkey")).alias("entity"), at.alias("at"))
    return kg.as_of_many(M.triples(spark, sf), asked).select("o_orderkey", "entity", "id", "predicate", "other")


def kg_relationship(spark, sf):
    return kg.relationship(M.triples(spark, sf), M.entities(spark, sf), NAME, "Located In")


def kg_timeline(spark, sf):
    return kg.timeline(M.triples(spark, sf), M.entities(spark, sf))


def kg_timeline_entity(spark, sf):
    return kg.timeline(M.triples(spark, sf), M.entities(spark, sf), NAME)


def kg_stats(spark, sf):
    return kg.statistics(M.triples(spark, sf), M.entities(spark, sf))


def kg_current_by_wing(spark, sf):
    t = M.triples(spark, sf).join(M.table(spark, sf, "customer").select(F.concat(F.lit("customer_"), F.col("c_custkey")).alias("subject"), F.concat(F.lit("drawer_"), F.col("c_mktsegment")).alias("source_drawer_id")), "subject")
    d = M.table(spark, sf, "customer").select(F.concat(F.lit("drawer_"), F.col("c_mktsegment")).alias("id"), F.col("c_mktsegment").alias("wing")).distinct()
    return kg.current_of_wing(t, d, "BUILDING")


def kg_invalidate_result(spark, sf):
    return kg.invalidate(M.triples(spark, sf), NAME, "located in", "nation_9", "2001-05-05").filter("predicate = 'located_in'").select("id", "subject", "object", "valid_from", "valid_to")


def kg_add_dedupe(spark, sf):
    """Facts of suppliers and customers: those of customers are stored."""
    c, s = M.table(spark, sf, "customer"), M.table(spark, sf, "supplier")
    row = lambda a, b: (a.alias("subject"), F.lit("Located In").alias("predicate"), b.alias("object"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    new = c.select(*row(F.concat(F.lit("Customer "), F.col("c_custkey")), F.concat(F.lit("Nation "), F.col("c_nationkey"))), F.lit(1.0).alias("confidence"))
    new = new.unionAll(s.select(*row(F.concat(F.lit("O'Supplier "), F.col("s_suppkey")), F.concat(F.lit("Nation "), F.col("s_nationkey"))), (F.col("s_acctbal") / 5000).alias("confidence")))
    return kg.add_facts(M.triples(spark, sf), new).select("subject", "predicate", "object")


def room_nodes(spark, sf):
    return graph.room_nodes(M.graph_drawers(spark, sf)).select("room", F.array_join("wings", ",").alias("wings"), "n")


def room_edges(spark, sf):
    return graph.room_edges(graph.room_nodes(M.graph_drawers(spark, sf)))


def find_tunnels(spark, sf):
    rows = graph.shown(graph.tunnels(graph.room_nodes(M.graph_drawers(spark, sf))), F.desc("n"), "room")
    return rows.select("room", F.array_join("wings", ",").alias("wings"), "n", "truncated")


def graph_stats(spark, sf):
    return graph.statistics(graph.room_nodes(M.graph_drawers(spark, sf)))


def rooms_per_wing(spark, sf):
    return graph.rooms_per_wing(graph.room_nodes(M.graph_drawers(spark, sf)))


def traverse_hops(spark, sf):
    return graph.traverse(graph.room_nodes(M.graph_drawers(spark, sf, 97)), "r1", 4).select("room", "hop", "n", F.array_join("via", ",").alias("via"))


def _topic_tunnels(spark, sf):
    return graph.topic_tunnels(M.topics(spark, sf), 2)


def topic_tunnels(spark, sf):
    return _topic_tunnels(spark, sf).select("id", "wing_a", "wing_b", "room", "label", "shared")


def follow_tunnels(spark, sf):
    links = graph.topic_tunnels(M.topics(spark, sf), 1).select("id", "wing_a", F.lower("room").alias("room_a"), "wing_b", F.lower("room").alias("room_b"), F.lower("label").alias("label"))
    nodes = links.groupBy("room_a").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "room_a").limit(1)
    room = nodes.first()
    return graph.follow(links, "Brand#22", room["room_a"] if room else "").select("direction", "wing", "room", "label")


def author_components(spark, sf):
    o = M.table(spark, sf, "orders")
    commits = o.select(F.concat(F.lit("Author "), F.col("o_custkey")).alias("name"), F.concat(F.lit("mail"), F.floor(F.col("o_custkey") / 3) * 2 + F.col("o_orderkey") % 2, F.lit("@x.org")).alias("email"), F.col("o_orderpriority").alias("repo"))
    return graph.people(commits)


def jaccard_pairs(spark, sf):
    files = M.drawers(spark, sf).select("id", "source_file")
    return dedup.jaccard_pairs(M.postings(spark, sf), files).select("source_file", "a", "b", M.rounded(F.col("jaccard")).alias("jaccard"))


def jaccard_pairs_low(spark, sf):
    files = M.drawers(spark, sf).select("id", "source_file")
    return dedup.jaccard_pairs(M.postings(spark, sf), files, 0.6).select("source_file", "a", "b", M.rounded(F.col("jaccard")).alias("jaccard"))


def dedup_greedy(spark, sf):
    """Drawers that go as copies of others of their file, all pairs looked at."""
    d = M.drawers(spark, sf)
    pairs = dedup.jaccard_pairs(M.postings(spark, sf), d.select("id", "source_file"))
    return dedup.greedy(pairs, d.select("id", "source_file", F.length("content").alias("length")))


def dedup_greedy_low(spark, sf):
    """Drawers that would go at half of similarity, all pairs looked at."""
    d = M.drawers(spark, sf)
    pairs = dedup.jaccard_pairs(M.postings(spark, sf), d.select("id", "source_file"), 0.5)
    return dedup.greedy(pairs, d.select("id", "source_file", F.length("content").alias("length")), None)


_K, _G = f"WITH {M.KG}", f"WITH {M.GRAPH}"
_NODES = f"{_G}, nodes AS (SELECT room, list_sort(list(DISTINCT wing)) AS wings, count(*) AS n FROM graph_drawers WHERE room <> 'general' AND room <> '' GROUP BY room)"
_OUT = "SELECT 'outgoing' AS direction, '{n}' AS subject, t.predicate, e.name AS object, t.valid_from, t.valid_to, t.valid_to IS NULL AS current FROM triples t JOIN entities e ON t.object = e.id WHERE t.subject = '{i}'"
_IN = "SELECT 'incoming' AS direction, e.name AS subject, t.predicate, '{n}' AS object, t.valid_from, t.valid_to, t.valid_to IS NULL AS current FROM triples t JOIN entities e ON t.subject = e.id WHERE t.object = '{i}'"
_START = "CASE WHEN length({c}) = 10 THEN {c} || 'T00:00:00Z' ELSE {c} END".format(c="valid_from")
_END = "CASE WHEN length({c}) = 10 THEN {c} || 'T23:59:59Z' ELSE {c} END".format(c="valid_to")
_LIVE = f"(valid_from IS NULL OR {_START} <= '{DAY}T00:00:00Z') AND (valid_to IS NULL OR {_END} >= '{DAY}T00:00:00Z')"
_TIME = "SELECT t.id, s.name AS subject, t.predicate, o.name AS object, t.valid_from, t.valid_to, t.valid_to IS NULL AS current FROM triples t JOIN entities s ON t.subject = s.id JOIN entities o ON t.object = o.id"
_PAIRS = """WITH {words}, w AS (SELECT DISTINCT d.source_file, t.id, t.word FROM words t JOIN drawers d USING (id)), s AS (SELECT id, count(*) AS n FROM w GROUP BY id),
c AS (SELECT a.source_file, a.id AS a, b.id AS b, count(*) AS k FROM w a JOIN w b ON a.source_file = b.source_file AND a.word = b.word AND a.id < b.id GROUP BY ALL)
SELECT source_file, a, b, round(k / (x.n + y.n - k), 6) AS jaccard FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE k / (x.n + y.n - k) >= {least}"""
_TOPIC = f"""WITH {M.TOPICS}, own AS (SELECT lower(replace(replace(wing, ' ', '_'), '-', '_')) AS wing, lower(trim(topic)) AS key, arg_min(trim(topic), position) AS name FROM topics GROUP BY 1, 2),
p AS (SELECT a.wing AS wing_a, b.wing AS wing_b, a.key, a.name, count(*) OVER (PARTITION BY a.wing, b.wing) AS shared FROM own a JOIN own b ON a.key = b.key AND a.wing < b.wing)"""
_GREEDY = _PAIRS.replace("WITH {words}", "WITH RECURSIVE {words}").replace(")\nSELECT source_file, a, b, round", "),\nj AS (SELECT source_file, a, b, round") + """),
r AS (SELECT id, length(content) AS length, row_number() OVER (PARTITION BY source_file ORDER BY length(content) DESC, id) - 1 AS rank, count(*) OVER (PARTITION BY source_file) AS size FROM drawers),
o AS (SELECT source_file, CASE WHEN x.rank < y.rank THEN a ELSE b END AS i, CASE WHEN x.rank < y.rank THEN b ELSE a END AS j, x.size AS size, least(x.rank, y.rank) AS ri, greatest(x.rank, y.rank) AS rj,
  CASE WHEN x.rank < y.rank THEN x.length <= y.length ELSE y.length <= x.length END AS drop_i FROM j JOIN r x ON x.id = a JOIN r y ON y.id = b),
p AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ri, rj) AS step FROM o WHERE {most}),
walk(source_file, step, gone) AS (SELECT DISTINCT source_file, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM p
  UNION ALL SELECT p.source_file, p.step, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone WHEN drop_i THEN list_append(gone, i) ELSE list_append(gone, j) END FROM walk w JOIN p ON p.source_file = w.source_file AND p.step = w.step + 1)
SELECT source_file, unnest(gone) AS id FROM (SELECT source_file, arg_max(gone, step) AS gone FROM walk GROUP BY source_file)"""
ORACLE_SQL = {
    "kg_as_of_many": f"""{_K}, q AS (SELECT o_orderkey, 'customer_' || o_custkey AS entity, strftime(CAST(o_orderdate AS DATE) + 10, '%Y-%m-%d') || CASE WHEN o_orderkey % 3 = 0 THEN 'T12:00:00Z' ELSE 'T00:00:00Z' END AS key FROM orders)
SELECT o_orderkey, entity, t.id, predicate, object AS other FROM q JOIN triples t ON t.subject = q.entity WHERE (valid_from IS NULL OR {_START} <= key) AND (valid_to IS NULL OR {_END} >= key)""",
    "dedup_greedy": _GREEDY.format(words=M.WORDS, least=0.85, most="true"),
    "dedup_greedy_low": _GREEDY.format(words=M.WORDS, least=0.5, most="true"),
    "kg_outgoing": f"{_K} {_OUT.format(n=NAME, i=NAME)}",
    "kg_incoming": f"{_K} {_IN.format(n='Nation 7', i='nation_7')}",
    "kg_both": f"{_K} {_OUT.format(n='nation_7', i='nation_7')} UNION ALL {_IN.format(n='nation_7', i='nation_7')}",
    "kg_as_of": f"{_K} {_OUT.format(n=NAME, i=NAME)} AND {_LIVE}",
    "kg_as_of_all": f"{_K} SELECT predicate, count(*) AS n FROM triples WHERE {_LIVE} GROUP BY predicate",
    "kg_relationship": f"{_K} SELECT '{NAME}' AS subject, t.predicate, e.name AS object, valid_from, valid_to, valid_to IS NULL AS current FROM triples t JOIN entities e ON t.object = e.id WHERE subject = '{NAME}' AND predicate = 'located_in'",
    "kg_timeline": f"{_K} {_TIME} ORDER BY t.valid_from NULLS FIRST, t.id LIMIT 100",
    "kg_timeline_entity": f"{_K} {_TIME} WHERE t.subject = '{NAME}' OR t.object = '{NAME}'",
    "kg_stats": f"{_K} SELECT (SELECT count(*) FROM entities) AS entities, count(*) AS triples, count(*) FILTER (valid_to IS NULL) AS current, count(*) FILTER (valid_to IS NOT NULL) AS expired, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT predicate AS p FROM triples)) AS predicates FROM triples",
    "kg_current_by_wing": f"{_K} SELECT DISTINCT subject, predicate FROM triples JOIN customer ON subject = 'customer_' || c_custkey WHERE valid_to IS NULL AND c_mktsegment = 'BUILDING' ORDER BY subject, predicate LIMIT 20",
    "kg_invalidate_result": f"{_K} SELECT id, subject, object, valid_from, CASE WHEN subject = '{NAME}' AND object = 'nation_9' AND valid_to IS NULL THEN '2001-05-05' ELSE valid_to END AS valid_to FROM triples WHERE predicate = 'located_in'",
    "kg_add_dedupe": "SELECT DISTINCT 'osupplier_' || s_suppkey AS subject, 'located_in' AS predicate, 'nation_' || s_nationkey AS object FROM supplier WHERE s_acctbal / 5000 BETWEEN 0 AND 1",
    "room_nodes": f"{_NODES} SELECT room, array_to_string(wings, ',') AS wings, n FROM nodes",
    "room_edges": f"{_NODES}, w AS (SELECT room, n, unnest(wings) AS wing FROM nodes) SELECT a.room, a.wing AS wing_a, b.wing AS wing_b, a.n FROM w a JOIN w b ON a.room = b.room AND a.wing < b.wing",
    "find_tunnels": f"{_NODES} SELECT room, array_to_string(wings, ',') AS wings, n, (SELECT count(*) > 50 FROM nodes WHERE len(wings) >= 2) AS truncated FROM nodes WHERE len(wings) >= 2 ORDER BY n DESC, room LIMIT 50",
    "graph_stats": f"{_NODES} SELECT count(*) AS rooms, count(*) FILTER (len(wings) >= 2) AS tunnel_rooms, CAST(sum(len(wings) * (len(wings) - 1) // 2) AS BIGINT) AS edges FROM nodes",
    "rooms_per_wing": f"{_NODES} SELECT wing, count(*) AS rooms FROM (SELECT unnest(wings) AS wing FROM nodes) GROUP BY wing",
    "traverse_hops": _G.replace("WITH", "WITH RECURSIVE", 1).replace("% 2003", "% 97") + """, rw AS (SELECT DISTINCT room, wing FROM graph_drawers), walk(room, hop) AS (
  SELECT 'r1', 0 UNION SELECT b.room, hop + 1 FROM walk JOIN rw a USING (room) JOIN rw b ON a.wing = b.wing WHERE hop < 4),
h AS (SELECT room, min(hop) AS hop FROM walk GROUP BY room),
v AS (SELECT h.room, f.room AS came, string_agg(DISTINCT a.wing, ',' ORDER BY a.wing) AS via, row_number() OVER (PARTITION BY h.room ORDER BY f.room) AS k
  FROM h JOIN rw a ON a.room = h.room JOIN rw b ON b.wing = a.wing JOIN h f ON f.room = b.room AND f.hop = h.hop - 1 GROUP BY h.room, f.room)
SELECT h.room, CAST(hop AS INTEGER) AS hop, n.n AS n, v.via FROM h JOIN (SELECT room, count(*) AS n FROM graph_drawers GROUP BY room) n USING (room) LEFT JOIN v ON v.room = h.room AND v.k = 1""",
    "author_components": """WITH RECURSIVE c AS (SELECT 'Author ' || o_custkey AS name, 'mail' || (o_custkey // 3 * 2 + o_orderkey % 2) || '@x.org' AS email, o_orderpriority AS repo FROM orders),
ne AS (SELECT DISTINCT name, email FROM c), r(a, b) AS (SELECT DISTINCT name, name FROM ne UNION SELECT r.a, y.name FROM r JOIN ne x ON r.b = x.name JOIN ne y ON x.email = y.email),
g AS (SELECT a AS name, min(b) AS person FROM r GROUP BY a),
t AS (SELECT person, count(*) AS commits, count(DISTINCT email) AS emails, count(DISTINCT repo) AS repos FROM c JOIN g USING (name) GROUP BY person),
k AS (SELECT person, name, row_number() OVER (PARTITION BY person ORDER BY count(*) DESC, name) AS k FROM c JOIN g USING (name) GROUP BY person, name)
SELECT name, commits, emails, repos FROM t JOIN k USING (person) WHERE k = 1""",
    "topic_tunnels": f"""{_TOPIC} SELECT substr(sha256(least(wing_a || '/topic:' || name, wing_b || '/topic:' || name) || '↔' || greatest(wing_a || '/topic:' || name, wing_b || '/topic:' || name)), 1, 16) AS id,
  wing_a, wing_b, 'topic:' || name AS room, 'shared topic: ' || name AS label, shared FROM p WHERE shared >= 2""",
    "follow_tunnels": f"""{_TOPIC}, l AS (SELECT wing_a, wing_b, 'topic:' || key AS room FROM p), best AS (SELECT room FROM l GROUP BY room ORDER BY count(*) DESC, room LIMIT 1)
SELECT CASE WHEN wing_a = 'brand#22' THEN 'outgoing' ELSE 'incoming' END AS direction, CASE WHEN wing_a = 'brand#22' THEN wing_b ELSE wing_a END AS wing, room, 'shared topic: ' || substr(room, 7) AS label
FROM l WHERE room IN (SELECT room FROM best) AND (wing_a = 'brand#22' OR wing_b = 'brand#22')""",
    "jaccard_pairs": _PAIRS.format(words=M.WORDS, least=0.85),
    "jaccard_pairs_low": _PAIRS.format(words=M.WORDS, least=0.6),
}
QUERIES = {f.__name__: f for f in (kg_outgoing, kg_incoming, kg_both, kg_as_of, kg_as_of_all, kg_as_of_many, kg_relationship, kg_timeline, kg_timeline_entity, kg_stats, kg_current_by_wing, kg_invalidate_result, kg_add_dedupe, room_nodes, room_edges, find_tunnels, graph_stats, rooms_per_wing, traverse_hops, topic_tunnels, follow_tunnels, author_components, jaccard_pairs, jaccard_pairs_low, dedup_greedy, dedup_greedy_low)}
