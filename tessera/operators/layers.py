"""What a session wakes up with: identity, the essential story with facts, and deep search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.operators.browse import STORY_BYTES, essential_story, where
from tessera.operators.stored_index import SearchIndex

#: Pairs of a subject and predicate that the story tells, characters of a snippet, and chunks beside the best hit.
PAIRS, SNIPPET, RADIUS = 20, 300, 2
#: Lines that one pair can have within the budget: the shortest has a mark, two spaces and three letters more.
PER_PAIR = STORY_BYTES // 9 + 1
CUT = "  ... (more in L3 search)"


def identity(text: str | None) -> str:
    """The heading of who the session is for, from what its file holds."""
    held = (text or "").strip()
    return f"## L0 — IDENTITY\n{held or 'No identity configured.'}"


def fact_lines(triples: DataFrame, entities: DataFrame, used: int | Column = 0, drawers: DataFrame | None = None, wing: str | None = None) -> DataFrame:
    """(position, line): a heading and the facts of the first pairs of a subject and predicate that hold now.

    With a wing, only facts of its drawers name pairs.  All facts of a pair are
    told, ended ones too, in one join for all pairs; a subject with very many
    facts gives no more than the budget can hold, and lines end before ``used``
    and their own bytes pass it.  Without a pair there is no heading.
    """
    now = triples.filter("valid_to is null")
    if wing is not None:
        now = now.join(where(drawers, wing=wing).select(F.col("id").alias("source_drawer_id")), "source_drawer_id", "left_semi")
    names = lambda c: entities.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    pairs = now.select("subject", "predicate").distinct().join(names("subject"), "subject").orderBy("subject_name", "predicate", "subject").limit(PAIRS)
    told = triples.join(F.broadcast(pairs.filter("subject_name <> '' and predicate <> ''")), ["subject", "predicate"]).join(names("object"), "object")
    place = W.partitionBy("subject", "predicate").orderBy("object_name", "id")
    told = told.withColumn("k", F.row_number().over(place)).filter(F.col("k") <= PER_PAIR)
    line = F.concat(F.lit("  - "), "subject_name", F.lit(" "), "predicate", F.lit(" "), "object_name")
    head = pairs.limit(1).select(F.lit("").alias("subject_name"), F.lit("").alias("predicate"), F.lit("").alias("subject"), F.lit(0).alias("k"), F.lit("\n[knowledge graph]").alias("line"))
    rows = told.select("subject_name", "predicate", "subject", "k", line.alias("line")).unionByName(head)
    order = W.orderBy("subject_name", "predicate", "subject", "k")  # at most PAIRS times PER_PAIR lines
    over = F.sum(F.octet_length("line")).over(order.rowsBetween(W.unboundedPreceding, 0)) + used > STORY_BYTES
    numbered = rows.select(F.row_number().over(order).alias("position"), "line", over.alias("over"))
    # lines go on as long as the sum does, so the first that passes ends them
    return numbered.filter(~F.col("over")).select("position", "line")


def wake_story(drawers: DataFrame, triples: DataFrame, entities: DataFrame, wing: str | None = None) -> DataFrame:
    """(part, position, line): the essential story and, if it isn't cut, facts in what is left of its bytes.

    Without drawers there is nothing to tell, facts included.
    """
    story = essential_story(drawers, wing)
    spent = story.agg(F.sum(F.octet_length("line")).alias("used"), F.max((F.col("line") == CUT).cast("int")).alias("cut")).first()
    rows = story.select(F.lit(1).alias("part"), "position", "line")
    if spent["cut"] or spent["used"] is None:
        return rows
    return rows.unionAll(fact_lines(triples, entities, spent["used"], drawers, wing).select(F.lit(2).alias("part"), "position", "line"))


def _one_line(content: Column) -> Column:
    return F.replace(F.substring(content, 1, SNIPPET), F.lit("\n"), F.lit(" "))


def deep_search(index: SearchIndex, query: str, n: int, wing: str | None = None, room: str | None = None) -> DataFrame:
    """(position, line): hits with snippets and sources, then the chunks beside the best one.

    Reads the folders of the query's words and of the hits' files only.
    """
    hits = index.contents_of(index.search(query, n, wing, room))
    rank = F.row_number().over(W.orderBy(F.desc("relevance"), "id"))  # as many rows as were asked for
    ranked = hits.withColumn("rank", rank)
    head = F.format_string("  [%d] %s/%s (score=%.1f, chunk=%d)", "rank", "wing", "room", "relevance", F.col("chunk_index").cast("long"))
    text = F.concat(F.lit("      "), _one_line(F.col("content")), F.when(F.octet_length("content") > SNIPPET, "...").otherwise(""))
    source = F.when(F.coalesce("source_file", F.lit("")) != "", F.concat(F.lit("      src: "), "source_file"))
    lines = F.filter(F.array(head, text, source), lambda x: x.isNotNull())
    rows = ranked.select(F.col("rank"), F.posexplode(lines).alias("k", "line"))
    near = index.neighbours(ranked.filter("rank = 1").select("id", "source_file", "chunk_index"), RADIUS)
    beside = near.select(F.lit(1 << 20).alias("rank"), (F.col("chunk_index") + 1).cast("int").alias("k"), F.concat(F.lit("        chunk "), F.col("chunk_index").cast("string"), F.lit(": "), _one_line(F.col("content"))).alias("line"))
    title = near.limit(1).select(F.lit(1 << 20).alias("rank"), F.lit(0).alias("k"), F.lit("      nearby context:").alias("line"))
    every = rows.unionByName(beside).unionByName(title)
    return every.select(F.row_number().over(W.orderBy("rank", "k")).alias("position"), "line")


def wake_up(identity_text: str | None, drawers: DataFrame, triples: DataFrame, entities: DataFrame, wing: str | None = None) -> str:
    """The whole text of a wake-up, with the tokens that it may take; the story is bounded by its bytes."""
    lines = [r["line"] for r in wake_story(drawers, triples, entities, wing).orderBy("part", "position").collect()]
    story = "\n".join(["## L1 — ESSENTIAL STORY", *lines]) if lines else "## L1 — No memories yet."
    text = f"{identity(identity_text)}\n\n{story}"
    return f"{text}\n\n(~{len(text.encode()) // 4} tokens)"
