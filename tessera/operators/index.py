"""The inverted word index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.text import repeats, run_starts, tokens


def build_postings(drawers: DataFrame) -> DataFrame:
    """(word, id, n) for ``drawers`` (id, content).

    Words are counted within their row, so nothing moves; only rows that repeat an
    id are summed.
    """
    each = counted(drawers.select("id", tokens(F.col("content")).alias("ts")), "ts").select("word", "id", "n")
    return each.groupBy("word", "id").agg(F.sum("n").alias("n")) if repeats(drawers, "id") else each


def counted(rows: DataFrame, words: str) -> DataFrame:
    """``rows`` with a row for each distinct item of the array column ``words`` instead of it: word and n, its count."""
    kept = [c for c in rows.columns if c != words]
    runs = rows.select(*kept, F.sort_array(words).alias("_words")).withColumn("_starts", run_starts("_words"))
    end = lambda k: F.coalesce(F.get("_starts", k + 1), F.size("_words"))
    each = F.transform("_starts", lambda at, k: F.struct(F.get("_words", at).alias("word"), (end(k) - at).cast("long").alias("n")))
    return runs.select(*kept, F.inline(each))


def doc_lengths(postings: DataFrame) -> DataFrame:
    """Tokens of each drawer."""
    return postings.groupBy("id").agg(F.sum("n").alias("length"))


def add_postings(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` whose (word, id) it lacks; counts never add up."""
    return old.unionByName(new.join(old, ["word", "id"], "left_anti"))


def integrity(drawers: DataFrame, postings: DataFrame) -> DataFrame:
    """Drawers without postings and postings without a drawer, as (problem, id)."""
    indexed = postings.select("id").distinct()
    usable = drawers.select("id", F.size(tokens(F.col("content"))).alias("k")).filter("k > 0").select("id")
    missing = usable.join(indexed, "id", "left_anti").select(F.lit("unindexed").alias("problem"), "id")
    return missing.unionAll(indexed.join(drawers.select("id"), "id", "left_anti").select(F.lit("orphan").alias("problem"), "id"))


def rebuild_is_safe(extracted: int, stored: int | None, page: int = 10_000) -> bool:
    """Whether an extraction is whole enough to replace the index.

    Fewer rows than stored, or exactly a page when the stored number is unknown,
    look like a truncated read.
    """
    return extracted != page if stored is None else extracted >= stored
