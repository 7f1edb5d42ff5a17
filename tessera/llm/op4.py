"""op4: near-duplicate vectors of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.multi_index import near_duplicates
from tessera.llm.tables import table


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(a, b) AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (
  SELECT a, min(b) AS low FROM r GROUP BY a
), k AS (
  SELECT a, count(*) AS n FROM e GROUP BY a
)
SELECT m.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, least(m.vec_id, coalesce(c.low, m.vec_id)) AS component_id, least(m.vec_id, coalesce(c.low, m.vec_id)) = m.vec_id AS kept
FROM embeddings m LEFT JOIN c ON c.a = m.vec_id LEFT JOIN k ON k.a = m.vec_id
"""
