"""Markdown of the drawers, and compressed lines as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.functions.dialect import compressed
from tessera.runtime import materialize


def _safe(c):
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_")


def markdown_rows(drawers: DataFrame) -> DataFrame:
    """(file, at, text): a heading and the drawers of each wing and room, in order of time."""
    d = drawers.filter("wing <> '' and room <> '' and content <> ''").withColumn("file", F.concat(_safe(F.col("wing")), F.lit("/"), _safe(F.col("room")), F.lit(".md")))
    at = F.row_number().over(W.partitionBy("file").orderBy("filed_at", "id"))
    body = d.select("file", at.alias("at"), F.concat(F.lit("### "), F.coalesce(F.date_format("filed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("undated")), F.lit("\n\n"), F.col("content"), F.lit("\n\n---\n")).alias("text"))
    heads = d.groupBy("file").agg(F.concat(F.lit("# Wing: "), F.min("wing"), F.lit(" / Room: "), F.min("room"), F.lit("\n")).alias("text")).select("file", F.lit(0).alias("at"), "text")
    return heads.unionByName(body)


def index_rows(drawers: DataFrame) -> DataFrame:
    """Lines of the index: a link to the file of each wing and room."""
    pairs = drawers.filter("wing <> '' and room <> '' and content <> ''").select("wing", "room").distinct()
    return pairs.select(F.concat(F.lit("- ["), F.col("room"), F.lit("]("), _safe(F.col("wing")), F.lit("/"), _safe(F.col("room")), F.lit(".md)")).alias("line"), "wing", "room")


def write_markdown(drawers: DataFrame, path: str) -> None:
    """Write the rows as text, a folder for each file, in order within."""
    rows = markdown_rows(drawers).repartitionByRange("file", "at").sortWithinPartitions("file", "at")
    rows.select("file", F.col("text").alias("value")).write.partitionBy("file").text(path)


def closets(drawers: DataFrame) -> DataFrame:
    """Compressed lines of the drawers as rows of the closet table."""
    lines = materialize(compressed(drawers), "closets")
    return drawers.join(lines, "id").select("id", F.col("line").alias("content"), F.col("ratio").alias("compression_ratio"), "wing", "room", "source_file", "filed_at")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new``, which replace those of the same id."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)
