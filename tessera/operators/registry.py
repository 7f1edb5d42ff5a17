"""Known people, projects and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import quoted
from tessera.operators.mentions import mentions

#: Contexts of a person and of a plain word; {} is the name.
PERSON = (
    r"\b{}\s+said\b", r"\b{}\s+told\b", r"\b{}\s+asked\b", r"\b{}\s+laughed\b", r"\b{}\s+smiled\b", r"\b{}\s+was\b", r"\b{}\s+is\b", r"\b{}\s+called\b", r"\b{}\s+texted\b",
    r"\bwith\s+{}\b", r"\bsaw\s+{}\b", r"\bcalled\s+{}\b", r"\btook\s+{}\b", r"\bpicked\s+up\s+{}\b", r"\bdrop(?:ped)?\s+(?:off\s+)?{}\b", r"\b{}(?:'s|s')\b", r"\bhey\s+{}\b", r"\bthanks?\s+{}\b",
    r"(?m)^{}[:\s]", r"\bmy\s+(?:son|daughter|kid|child|brother|sister|friend|partner|colleague|coworker)\s+{}\b",
)
CONCEPT = (r"\bhave\s+you\s+{}\b", r"\bif\s+you\s+{}\b", r"\b{}\s+since\b", r"\b{}\s+again\b", r"\bnot\s+{}\b", r"\b{}\s+more\b", r"\bwould\s+{}\b", r"\bcould\s+{}\b", r"\bwill\s+{}\b", r"(?:the\s+)?{}\s+(?:of|in|at|for|to)\b")


def _hits(text: Column, name: Column, templates: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for t in templates:
        before, _, after = t.partition("{}")
        out = out + F.regexp_like(text, F.concat(F.lit("(?i)" + before), quoted(name), F.lit(after))).cast("int")
    return out


def lookup(words: DataFrame, people: DataFrame, projects: DataFrame, cache: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """What each of ``words`` (word, context) is: a person, a project, cached or unknown.

    ``people`` is (name, alias, confidence, source) with one row a name or
    alias, ``projects`` (name), ``cache`` (word, kind, confidence, confirmed) and
    ``ambiguous`` (word).  An ambiguous word goes by its context: more person
    contexts make a person, more others a concept, and a tie stays a person.
    """
    key = F.lower("word")
    p = people.groupBy(F.lower("alias").alias("_k")).agg(F.min(F.struct("name", "confidence", "source")).alias("p"))
    j = projects.groupBy(F.lower("name").alias("_k")).agg(F.min("name").alias("project"))
    c = cache.filter("confirmed").groupBy(F.lower("word").alias("_k")).agg(F.min(F.struct("kind", "confidence")).alias("c"))
    a = ambiguous.select(F.lower("word").alias("_k"), F.lit(True).alias("_a")).distinct()
    rows = words.withColumn("_k", key)
    for t in (p, j, c, a):
        rows = rows.join(t, "_k", "left")
    score = _hits(F.col("context"), F.col("word"), PERSON) - _hits(F.col("context"), F.col("word"), CONCEPT)
    unclear = F.coalesce(F.col("_a"), F.lit(False)) & (F.coalesce("context", F.lit("")) != "")
    kind = F.when(F.col("p").isNotNull() & unclear & (score < 0), "concept").when(F.col("p").isNotNull(), "person").when(F.col("project").isNotNull(), "project").otherwise(F.coalesce("c.kind", F.lit("unknown")))
    confidence = F.when(F.col("p").isNotNull(), F.col("p.confidence")).when(F.col("project").isNotNull(), 1.0).otherwise(F.coalesce("c.confidence", F.lit(0.0)))
    return rows.select("word", "context", kind.alias("kind"), F.coalesce("p.name", "project", "word").alias("name"), confidence.alias("confidence"))


def people_in(queries: DataFrame, people: DataFrame) -> DataFrame:
    """(query, name) of the known people whose name or alias a query holds as words."""
    held = mentions(queries.select("query").distinct(), people.select(F.col("alias").alias("name")), "query", "query").select("query", F.col("name").alias("alias"))
    return held.join(people.select("alias", "name"), "alias").select("query", "name").distinct()


def learned(found: DataFrame, people: DataFrame, least: float = 0.75) -> DataFrame:
    """Detected people (name, n, kind, confidence) that are sure enough and not known yet."""
    sure = found.filter((F.col("kind") == "person") & (F.col("confidence") >= least))
    return sure.join(people.select(F.lower("alias").alias("_k")).distinct(), F.lower("name") == F.col("_k"), "left_anti").select("name", "confidence")


def merge_known(old: DataFrame, new: DataFrame) -> DataFrame:
    """Known names (category, name) of both; without case, the older spelling stays."""
    rows = old.select("category", "name", F.lit(0).alias("at")).unionByName(new.select("category", "name", F.lit(1).alias("at"))).filter(F.trim("name") != "")
    return rows.groupBy("category", F.lower("name").alias("_k")).agg(F.min(F.struct("at", "name")).alias("x")).select("category", "x.name")


def replace_topics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Topics (wing, topic, position); wings of ``new`` replace their old ones."""
    return old.join(new.select("wing").distinct(), "wing", "left_anti").unionByName(new)
