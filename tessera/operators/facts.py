"""Checking what texts claim against the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.text import entity_id
from tessera.operators.fuzzy import near_names
from tessera.operators.mentions import held
from tessera.runtime import materialize, small

#: The two forms of a claim.
SUBJECT_FIRST = r"\b([A-Z][\w-]+)\s+is\s+([A-Z][\w-]+)'s\s+([a-z]{3,20})\b"
POSSESSOR_FIRST = r"\b([A-Z][\w-]+)'s\s+([a-z]{3,20})\s+is\s+([A-Z][\w-]+)\b"


def claims(texts: DataFrame, ident: str = "i", text: str = "text") -> DataFrame:
    """(ident, subject, predicate, object, span) that the texts claim, in two forms."""
    groups = lambda p: [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for g in range(4)]
    rows = []
    for pattern, (s, r, o) in ((SUBJECT_FIRST, (1, 3, 2)), (POSSESSOR_FIRST, (3, 2, 1))):
        g = groups(pattern)
        zipped = F.arrays_zip(g[0].alias("span"), g[s].alias("subject"), g[r].alias("predicate"), g[o].alias("object"))
        rows.append(texts.select(ident, F.explode(zipped).alias("c")).select(ident, "c.subject", F.lower("c.predicate").alias("predicate"), "c.object", "c.span"))
    return rows[0].unionAll(rows[1])


def issues(found: DataFrame, triples: DataFrame, entities: DataFrame, today: str) -> DataFrame:
    """Claims that a current fact contradicts or that a closed fact no longer bears.

    All claims meet the facts of their subjects in one join.
    """
    names = entities.select(F.col("id").alias("object"), "name")
    facts = triples.join(names, "object").select("subject", F.lower("predicate").alias("known"), F.lower(F.trim("name")).alias("_object"), "valid_to")
    both = found.withColumn("_subject", entity_id(F.col("subject"))).alias("c").join(facts.alias("f"), (F.col("_subject") == F.col("f.subject")) & (F.lower(F.trim("c.object")) == F.col("_object")))
    kind = F.when(F.col("valid_to").isNull() & (F.col("known") != "") & (F.col("known") != F.col("predicate")), "relationship_mismatch").when(F.col("valid_to").isNotNull() & (F.col("known") == F.col("predicate")) & (F.col("valid_to") < today), "stale_fact")
    return both.withColumn("kind", kind).filter("kind is not null").select(*[F.col(f"c.{c}") for c in found.columns], "kind", "known", "valid_to")


def similar_names(texts: DataFrame, names: DataFrame, ident: str = "i", text: str = "text") -> DataFrame:
    """(ident, name, other, distance): known names that a text doesn't hold, one or two edits from one that it holds.

    ``names`` is a registry of known names and ``ident`` tells texts apart.
    """
    names = materialize(names.select("name").distinct(), "registry")
    near = materialize(near_names(names), "near-names")
    every = held(texts, names, ident, text).groupBy(ident).agg(F.collect_set("name").alias("_held"))
    each = every.select(ident, "_held", F.explode("_held").alias("name")).join(small(near), "name")
    return each.filter(~F.array_contains("_held", F.col("other"))).select(ident, "name", "other", "distance")
