"""Keyword search: candidates by term counts, then BM25 over the candidates."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions.text import basename, query_tokens
from tessera.runtime import materialize

#: Saturation, length weight, candidates for each result.
K1, B, OVERFETCH = 1.5, 0.75, 3
#: Boosts of the best files, and of all others that match.
CLOSET_BOOSTS, CLOSET_FALLBACK = (0.40, 0.25, 0.15, 0.08, 0.04), 0.02
#: Lengths of the query cleaner.
SAFE_QUERY, MAX_QUERY, MIN_SEGMENT = 200, 250, 3


def candidates(postings: DataFrame, drawers: DataFrame, words: list[str], n: int, wing: str | None = None, room: str | None = None) -> DataFrame:
    """The ``n`` drawers with the most occurrences of the words, ties by id.

    Empty drawers are left out before the limit.  The filter on words reaches
    the index, and the limit is a top-k of each task before it is one of all.
    """
    found = postings.filter(F.col("word").isin(sorted(set(words)))).groupBy("id").agg(F.sum("n").alias("tf"))
    pool = drawers.filter("content <> ''")
    for name, value in (("wing", wing), ("room", room)):
        if value is not None:
            pool = pool.filter(F.col(name) == value)
    return found.join(pool, "id").orderBy(F.desc("tf"), "id").limit(n)


def bm25_search(postings: DataFrame, drawers: DataFrame, query: str, n: int, wing: str | None = None, room: str | None = None, people: list[str] = []) -> DataFrame:
    """The ``n`` most relevant of ``drawers`` for a query.

    Repeated words of the query count repeatedly; ``people`` adds the words of
    names that the query lacks.  Document counts and the mean length are those
    of the candidates, three for each result.  Ties go to the smaller id.
    Returns the columns of ``drawers`` and ``relevance``; a query without words
    gives no row.
    """
    words = query_tokens(query)
    if not words:
        return drawers.withColumn("relevance", F.lit(0.0)).limit(0)
    words += [w for w in dict.fromkeys(w for p in people for w in query_tokens(p)) if w not in words]
    pool = materialize(candidates(postings, drawers, words, n * OVERFETCH, wing, room), "search-pool")
    ids = F.broadcast(pool.select("id"))  # as many rows as the limit has
    mine = materialize(postings.join(ids, "id"), "search-terms")
    lengths = mine.groupBy("id").agg(F.sum("n").alias("length"))
    facts = pool.select("id").join(lengths, "id", "left").agg(F.count("*").alias("total"), F.avg(F.coalesce("length", F.lit(1))).alias("avgdl"))
    asked = F.create_map(*[F.lit(x) for w, k in Counter(words).items() for x in (w, float(k))])
    terms = mine.filter(F.col("word").isin(sorted(set(words))))
    df = terms.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.ln((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = 1 - B + B * F.col("length") / F.col("avgdl")
    part = asked[F.col("word")] * idf * F.col("n") * (K1 + 1) / (F.col("n") + K1 * norm)
    one = F.broadcast(facts)  # a single row
    scores = terms.join(F.broadcast(df), "word").join(lengths, "id").crossJoin(one).groupBy("id").agg(F.sum(part).alias("relevance"))
    return pool.drop("tf").join(F.broadcast(scores), "id").orderBy(F.desc("relevance"), "id").limit(n)


def closet_boosts(results: DataFrame, closets: DataFrame, words: list[str]) -> DataFrame:
    """(source_file, boost) of the files of ``results`` whose closets hold query words.

    Files are ranked by the most words, repeated ones counted, that one closet
    row contains anywhere, ignoring case; ties by path.
    """
    files = F.broadcast(results.filter("source_file <> ''").select("source_file").distinct())
    low = F.lower("content")
    hits = sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    best = closets.filter("content <> ''").join(files, "source_file").groupBy("source_file").agg(F.max(hits).alias("hits")).filter("hits > 0")
    rank = F.row_number().over(W.orderBy(F.desc("hits"), "source_file"))
    boost = F.coalesce(F.get(F.array(*[F.lit(x) for x in CLOSET_BOOSTS]), rank - 1), F.lit(CLOSET_FALLBACK))
    return best.select("source_file", boost.alias("boost"))


def boosted(results: DataFrame, boosts: DataFrame) -> DataFrame:
    """``results`` with relevance raised by the boost of their file, best first."""
    up = F.col("relevance") * (1 + F.coalesce("boost", F.lit(0.0)))
    return results.join(boosts, "source_file", "left").withColumn("relevance", up).drop("boost").orderBy(F.desc("relevance"), "id")


def neighbours(drawers: DataFrame, anchors: DataFrame, radius: int) -> DataFrame:
    """Chunks within ``radius`` of each anchor (id, source_file, chunk_index), itself left out."""
    a = anchors.filter("source_file <> ''").select(F.col("id").alias("anchor"), "source_file", F.col("chunk_index").alias("at"))
    near = a.withColumn("chunk_index", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - radius), F.col("at") + radius))).filter("chunk_index <> at")
    return drawers.join(near.drop("at"), ["source_file", "chunk_index"])


def check_duplicate(postings: DataFrame, drawers: DataFrame, content: str, least: float = 3.0) -> DataFrame:
    """Drawers that a content finds with a relevance above ``least``, five at most."""
    return bm25_search(postings, drawers, content, 5).filter(F.col("relevance") > least)


def sanitized(raw: Column) -> Column:
    """A query without what a prompt may have put before it: struct (query, method)."""
    lines = F.filter(F.transform(F.split(raw, r"\r?\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    last = F.element_at(lines, -1)
    tail = lambda s: F.right(s, F.lit(MAX_QUERY))
    text = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    row = lambda q, m: F.struct(q.alias("query"), F.lit(m).alias("method"))
    usable = F.length(last) >= MIN_SEGMENT
    return F.when(F.length(text) <= SAFE_QUERY, row(text, "passthrough")).when(usable & last.rlike("[?？]\\s*[\"']?\\s*$"), row(tail(last), "question_extraction")).when(usable, row(tail(last), "tail_sentence")).otherwise(row(tail(text), "tail_truncation"))


def with_source_name(results: DataFrame) -> DataFrame:
    """Results with the base name of their file."""
    return results.withColumn("source_name", basename(F.col("source_file")))
