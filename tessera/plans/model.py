"""The input tables seen as the tables of the store.

``documents`` are the drawers: the source is the wing, the language the room,
and each thousand ids of a wing and room are a file.  Customers, orders and
nations are the entities and facts, parts the topics, conversations the
messages.  The SQL of each view is what the oracles start from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tessera.operators.index import build_postings
from tessera.operators.stored_index import SearchIndex
from tessera.runtime import new_path

_INDEXES: dict[tuple[str, str], SearchIndex] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drawers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    wing, room = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("general"))
    file = F.concat(F.lit("/corpus/"), wing, F.lit("/"), room, F.lit("/"), F.floor(F.col("doc_id") / 1000), F.lit(".txt"))
    mode = F.element_at(F.array(F.lit("diary"), F.lit("convos"), F.lit(None), F.lit("projects"), F.lit("projects")), (F.col("doc_id") % 5 + 1).cast("int"))
    out = d.select(
        F.concat(F.lit("drawer_"), wing, F.lit("_"), room, F.lit("_"), F.col("doc_id")).alias("id"),
        "doc_id",
        wing.alias("wing"),
        room.alias("room"),
        F.coalesce("text", F.lit("")).alias("content"),
        file.alias("source_file"),
        F.concat(F.lit("agent"), F.col("doc_id") % 3).alias("added_by"),
        mode.alias("ingest_mode"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("filed_at"),
    )
    at = F.row_number().over(W.partitionBy("source_file").orderBy("doc_id")) - 1
    return out.withColumn("chunk_index", at.cast("long"))


DRAWERS = """drawers AS (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY doc_id) - 1 AS chunk_index FROM (
    SELECT 'drawer_' || coalesce(source, 'none') || '_' || coalesce(lang, 'general') || '_' || doc_id AS id, doc_id,
      coalesce(source, 'none') AS wing, coalesce(lang, 'general') AS room, coalesce(text, '') AS content,
      '/corpus/' || coalesce(source, 'none') || '/' || coalesce(lang, 'general') || '/' || (doc_id // 1000) || '.txt' AS source_file,
      'agent' || (doc_id % 3) AS added_by,
      CASE doc_id % 5 WHEN 0 THEN 'diary' WHEN 1 THEN 'convos' WHEN 2 THEN NULL ELSE 'projects' END AS ingest_mode,
      TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS filed_at
    FROM documents))"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_postings(drawers(spark, sf_dir).select("id", "content"))


def search_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The stored index of the drawers, written by the first query of an application that asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = SearchIndex.build(drawers(spark, sf_dir), new_path(spark, "search-index"))
    return _INDEXES[key]


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_index(spark, sf_dir).postings.select("word", "id", "n")


def _sql_words() -> str:
    from tessera.functions.text import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""tokens AS (
  SELECT id, lower(w) AS word FROM (SELECT id, unnest(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM drawers)
  WHERE strlen(w) >= 3 AND lower(w) NOT IN ({stop})),
words AS (SELECT id, word, count(*) AS n FROM tokens GROUP BY id, word)"""


WORDS = f"{DRAWERS}, {_sql_words()}"


def graph_drawers(spark: SparkSession, sf_dir: str, squares: int = 2003) -> DataFrame:
    """A sparse graph: two documents a room, wings by squares modulo ``squares``."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("g"), i).alias("id"), F.concat(F.lit("w"), i * i % squares).alias("wing"), F.concat(F.lit("r"), F.floor(i / 2)).alias("room"))


GRAPH = "graph_drawers AS (SELECT 'g' || doc_id AS id, 'w' || (doc_id * doc_id % 2003) AS wing, 'r' || (doc_id // 2) AS room FROM documents)"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda t, key, name, kind: table(spark, sf_dir, t).select(F.concat(F.lit(f"{kind}_"), F.col(key)).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("order_"), F.col("o_orderkey")).alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("name"), F.lit("order").alias("type"))
    return named("customer", "c_custkey", "c_name", "customer").unionAll(named("nation", "n_nationkey", "n_name", "nation")).unionAll(named("region", "r_regionkey", "r_name", "region")).unionAll(orders)


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    row = lambda s, p, t, a, b, i: (i.alias("id"), s.alias("subject"), F.lit(p).alias("predicate"), t.alias("object"), a.alias("valid_from"), b.alias("valid_to"))
    ref = lambda kind, key: F.concat(F.lit(f"{kind}_"), F.col(key))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    start = F.when(F.col("o_orderkey") % 2 == 0, day).otherwise(F.concat(day, F.lit("T12:00:00Z")))
    end = F.when(F.col("o_orderstatus") == "F", F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd"))
    located = c.select(*row(ref("customer", "c_custkey"), "located_in", ref("nation", "c_nationkey"), none, none, F.concat(F.lit("t_c"), F.col("c_custkey"))))
    part = n.select(*row(ref("nation", "n_nationkey"), "part_of", ref("region", "n_regionkey"), none, none, F.concat(F.lit("t_n"), F.col("n_nationkey"))))
    ordered = o.select(*row(ref("customer", "o_custkey"), "ordered", ref("order", "o_orderkey"), start, end, F.concat(F.lit("t_o"), F.col("o_orderkey"))))
    return located.unionAll(part).unionAll(ordered)


KG = """entities AS (
  SELECT 'customer_' || c_custkey AS id, c_name AS name, 'customer' AS type FROM customer
  UNION ALL SELECT 'nation_' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'region_' || r_regionkey, r_name, 'region' FROM region
  UNION ALL SELECT 'order_' || o_orderkey, 'Order ' || o_orderkey, 'order' FROM orders),
triples AS (
  SELECT 't_c' || c_custkey AS id, 'customer_' || c_custkey AS subject, 'located_in' AS predicate, 'nation_' || c_nationkey AS object, CAST(NULL AS VARCHAR) AS valid_from, CAST(NULL AS VARCHAR) AS valid_to FROM customer
  UNION ALL SELECT 't_n' || n_nationkey, 'nation_' || n_nationkey, 'part_of', 'region_' || n_regionkey, NULL, NULL FROM nation
  UNION ALL SELECT 't_o' || o_orderkey, 'customer_' || o_custkey, 'ordered', 'order_' || o_orderkey,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T12:00:00Z' END,
    CASE WHEN o_orderstatus = 'F' THEN strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') END FROM orders)"""


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a label: the name, a letter short on every third part, with one twice on every fifth."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    label = "CASE WHEN p_partkey % 3 = 0 THEN concat(left(p_name, p_partkey % 7), substr(p_name, p_partkey % 7 + 2)) WHEN p_partkey % 5 = 0 THEN concat(left(p_name, p_partkey % 7), substr(p_name, greatest(p_partkey % 7, 1))) ELSE p_name END"
    return p.withColumn("label", F.trim(F.expr(label)))


PART_NAMES = """part_names AS (SELECT p_partkey, p_name, trim(CASE WHEN p_partkey % 3 = 0 THEN left(p_name, p_partkey % 7) || substr(p_name, p_partkey % 7 + 2)
  WHEN p_partkey % 5 = 0 THEN left(p_name, p_partkey % 7) || substr(p_name, greatest(p_partkey % 7, 1)) ELSE p_name END) AS label FROM part)"""


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of wings: part names of brands, every other in capitals."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("wing"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("topic"), F.col("p_partkey").alias("position"))


TOPICS = "topics AS (SELECT p_brand AS wing, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS topic, p_partkey AS position FROM part)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session"), "turn", "role", "text", F.concat(F.lit("u"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("uuid"))


MESSAGES = "messages AS (SELECT conv_id AS session, turn, role, text, 'u' || conv_id || '-' || turn AS uuid FROM conversations)"


def literal_rows(spark: SparkSession, texts: list[str]) -> DataFrame:
    """A corpus given in place: (i, text)."""
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def literal_sql(texts: list[str], name: str = "corpus") -> str:
    rows = ", ".join(f"({i}, '" + t.replace("'", "''") + "')" for i, t in enumerate(texts))
    return f"{name}(i, text) AS (VALUES {rows})"


def rounded(c: Column) -> Column:
    return F.round(c, 6)
