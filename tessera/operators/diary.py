"""Diary files and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.sources.chats import diary_sections


def decisions(files: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Add ``hash``, ``decision`` and ``skip`` to ``files`` (path, bytes, mtime, content).

    ``state`` (path, hash, bytes, mtime, entries) is what the last ingest left.
    A new file is ingested whole; one with another hash is rebuilt; an entry of
    ``state`` without a hash goes by size and time and skips what it has.
    """
    s = state.select("path", F.col("hash").alias("_hash"), F.col("bytes").alias("_bytes"), F.col("mtime").alias("_mtime"), "entries", F.lit(True).alias("_known"))
    rows = files.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256)).join(s, "path", "left")
    same = (F.col("_bytes") == F.col("bytes")) & (F.col("_mtime") == F.col("mtime")) & (F.col("mtime") > 0)
    by_hash = F.when(F.col("_hash") == F.col("hash"), "unchanged").otherwise("rebuild")
    decision = F.when(F.col("_known").isNull(), "incremental").when(F.col("_hash").isNotNull(), by_hash).otherwise(F.when(same, "unchanged").otherwise("incremental"))
    decision = F.lit("rebuild") if force else decision
    return rows.withColumns({"decision": decision, "skip": F.when(F.col("_known").isNotNull() & F.col("_hash").isNull(), F.col("entries")).otherwise(0)}).drop("_hash", "_bytes", "_mtime", "_known", "entries")


def entry_id(wing: Column, agent: Column, source: Column, date: Column, index: Column) -> Column:
    """Identifier of a section: wing, a hash of where it comes from, date and place."""
    prefix = F.regexp_replace(F.substring(wing, 1, 20), r"[^\p{L}\p{N}_]", "_")
    hashed = F.substring(F.sha2(F.concat_ws("\u0000", wing, agent, source).cast("binary"), 256), 1, 8)
    return F.concat_ws("-", F.lit("diary"), prefix, hashed, date, index.cast("string"))


def entries(files: DataFrame, wing: str, agent: str) -> DataFrame:
    """Sections of the files to ingest as drawers; the date is the file's name's."""
    date = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})[^/]*\.md$", 1)
    todo = files.filter("decision <> 'unchanged'").withColumn("date", date).filter("date <> ''")
    rows = todo.select("path", "date", "skip", F.posexplode(diary_sections(F.col("content"))).alias("n", "s")).filter(F.col("n") >= F.col("skip"))
    text = F.when(F.col("s.title") == "", F.col("s.body")).otherwise(F.concat(F.lit("## "), F.col("s.title"), F.lit("\n"), F.col("s.body")))
    return rows.select(entry_id(F.lit(wing), F.lit(agent), F.col("path"), F.col("date"), F.col("n")).alias("id"), F.lit(wing).alias("wing"), F.lit("diary").alias("room"), text.alias("content"), F.col("path").alias("source_file"), F.col("n").alias("chunk_index"), F.lit(agent).alias("added_by"), F.lit("diary").alias("ingest_mode"))


def stale(stored: DataFrame, files: DataFrame, fresh: DataFrame) -> DataFrame:
    """Ids of stored sections of rebuilt files that the new ones lack."""
    rebuilt = files.filter("decision = 'rebuild'").select(F.col("path").alias("source_file"))
    return stored.filter("ingest_mode = 'diary'").join(rebuilt, "source_file", "left_semi").join(fresh.select("id"), "id", "left_anti").select("id")


def new_state(files: DataFrame, state: DataFrame) -> DataFrame:
    """The state after an ingest of ``files``."""
    sections = F.size(diary_sections(F.col("content")))
    now = files.select("path", "hash", "bytes", "mtime", sections.alias("entries"))
    return state.join(now.select("path"), "path", "left_anti").unionByName(now)
