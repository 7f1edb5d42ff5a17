"""Listing, counting and rendering drawers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions.text import basename, preview, snippet

#: Drawers and bytes of the essential story.
STORY_DRAWERS, STORY_BYTES = 15, 3200


def where(drawers: DataFrame, **equal: str | None) -> DataFrame:
    """``drawers`` with the given columns equal to the values that aren't None."""
    for name, value in equal.items():
        if value is not None:
            drawers = drawers.filter(F.col(name) == value)
    return drawers


def taxonomy(drawers: DataFrame) -> DataFrame:
    """Drawers by wing and room."""
    return drawers.groupBy("wing", "room").agg(F.count("*").alias("n"))


def taxonomy_rollup(drawers: DataFrame) -> DataFrame:
    """Drawers by wing and room, by wing, and of all, in one pass."""
    return drawers.rollup("wing", "room").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def statistics(drawers: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: drawers, wings, rooms of wings, entities and facts."""
    d = drawers.agg(F.count("*").alias("drawers"), F.countDistinct("wing").alias("wings"), F.countDistinct("wing", "room").alias("rooms"))
    return d.crossJoin(entities.agg(F.count("*").alias("entities"))).crossJoin(triples.agg(F.count("*").alias("triples")))


def page(drawers: DataFrame, limit: int, offset: int = 0, **equal: str | None) -> DataFrame:
    """One page of drawers that aren't diary entries, the latest first, with previews."""
    rows = where(drawers, **equal).filter(~F.col("ingest_mode").eqNullSafe("diary"))
    return rows.orderBy(F.desc("filed_at"), F.desc("id")).offset(offset).limit(limit).select("id", "wing", "room", preview(F.col("content")).alias("preview"))


def diary(drawers: DataFrame, agent: str, last: int, wing: str | None = None) -> DataFrame:
    """The last diary entries of an agent."""
    rows = where(drawers, wing=wing).filter((F.col("ingest_mode") == "diary") & (F.col("added_by") == agent))
    return rows.orderBy(F.desc("filed_at"), F.desc("id")).limit(last)


def recent(drawers: DataFrame, n: int, wing: str | None = None, room: str | None = None) -> DataFrame:
    """The latest drawers with snippets of 300 characters."""
    rows = where(drawers, wing=wing, room=room).orderBy(F.desc("filed_at"), "id").limit(n)
    return rows.select("id", "wing", "room", snippet(F.col("content"), 300).alias("snippet"), basename(F.col("source_file")).alias("source_name"))


def essential_story(drawers: DataFrame, wing: str | None = None) -> DataFrame:
    """Lines of the essential story in order, cut before they pass the byte budget.

    The first drawers by (filed_at, id) are grouped by room; each room has a
    heading line.  The line that would pass the budget and all after it go, and
    one line says so.
    """
    first = where(drawers, wing=wing).orderBy("filed_at", "id").limit(STORY_DRAWERS)
    text = F.concat(F.substring(F.replace(F.substring("content", 1, 200), F.lit("\n"), F.lit(" ")), 1, 200), F.when(F.octet_length("content") > 200, "...").otherwise(""))
    name = basename(F.col("source_file"))
    line = F.concat(F.lit("  - "), text, F.when(name != "", F.concat(F.lit("  ("), name, F.lit(")"))).otherwise(""))
    rows = first.select("room", "filed_at", "id", line.alias("line"))
    heads = rows.groupBy("room").agg(F.lit(None).cast("timestamp").alias("filed_at"), F.lit("").alias("id"), F.first(F.concat(F.lit("\n["), F.col("room"), F.lit("]"))).alias("line"))
    order = W.orderBy("room", F.col("filed_at").asc_nulls_first(), "id")  # at most twice the story's drawers
    used = F.sum(F.octet_length("line")).over(order.rowsBetween(W.unboundedPreceding, 0))
    numbered = rows.unionByName(heads).select(F.row_number().over(order).alias("position"), "line", (used > STORY_BYTES).alias("over"), (F.col("id") == "").alias("head"))
    cut = numbered.filter(F.col("over") & ~F.col("head")).agg(F.min("position").alias("cut"))
    kept = numbered.crossJoin(cut).filter(F.col("cut").isNull() | (F.col("position") < F.col("cut"))).select("position", "line")
    return kept.unionAll(cut.filter("cut is not null").select(F.col("cut").alias("position"), F.lit("  ... (more in L3 search)").alias("line")))


def wake_up_tokens(text: Column) -> Column:
    """Tokens of the wake-up text: a quarter of its bytes."""
    return F.floor(F.octet_length(text) / 4).cast("int")


def file_freshness(rows: DataFrame) -> DataFrame:
    """The time of change that all rows of a file agree on, else null.

    ``rows`` has source_file and source_mtime; a null or negative time of any
    row, or two different ones, means that the file must be read again.
    """
    bad = F.count_if(F.col("source_mtime").isNull() | (F.col("source_mtime") < 0))
    agreed = F.when((bad == 0) & (F.min("source_mtime") == F.max("source_mtime")), F.min("source_mtime"))
    return rows.filter("source_file <> ''").groupBy("source_file").agg(agreed.alias("mtime"), F.count("*").alias("n"))


def folders_above(path: Column) -> Column:
    """The texts before each stroke of a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def sync_buckets(drawers: DataFrame, roots: DataFrame, present: DataFrame, ignored: DataFrame) -> DataFrame:
    """Each drawer's bucket: kept, gitignored, missing, no_source or out_of_scope.

    ``roots`` (root), ``present`` (source_file) and ``ignored`` (source_file)
    are tables; the longest root above a file counts.  Files are made distinct
    first, so each is compared with the roots once.
    """
    files = drawers.select("source_file").distinct().filter("source_file <> ''")
    # a file meets its roots by the folders above it
    folders = files.select("source_file", F.explode(folders_above(F.col("source_file"))).alias("_folder"))
    own = roots.select("root", F.rtrim(F.col("root"), F.lit("/")).alias("_folder"))
    above = folders.join(own, "_folder").groupBy("source_file").agg(F.max_by("root", F.length("root")).alias("root"))
    facts = files.join(above, "source_file", "left").join(present.distinct().withColumn("here", F.lit(True)), "source_file", "left").join(ignored.distinct().withColumn("out", F.lit(True)), "source_file", "left")
    bucket = F.when(F.col("root").isNull(), "out_of_scope").when(F.col("here").isNull(), "missing").when(F.col("out"), "gitignored").otherwise("kept")
    named = facts.select("source_file", "root", bucket.alias("bucket"))
    return drawers.join(named, "source_file", "left").withColumn("bucket", F.coalesce("bucket", F.lit("no_source")))


def export_groups(drawers: DataFrame) -> DataFrame:
    """What a Markdown export writes: a file name, rows and bytes for each wing and room."""
    rows = drawers.filter("wing <> '' and room <> '' and content <> ''")
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_")
    return rows.groupBy("wing", "room").agg(F.concat(safe(F.col("wing")), F.lit("/"), safe(F.col("room")), F.lit(".md")).alias("file"), F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"), F.min("id").alias("first_id"))
