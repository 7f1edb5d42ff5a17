"""op8: token totals of all documents after inserts, a revision and deletes.

Version word_bpe_49k counts the ids of a text and is revised to count the id at
its end as well.  Version byte_bpe_50k counts the ids of another vocabulary; all
but the first of each group of equal texts, the smallest doc_id, are deleted from
it.  Null texts count as empty ones; without ids a group has no first, and all
stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.rollups import Rollup, byte_counts, deletes, inserts, revisions, word_counts
from tessera.llm.small import small
from tessera.llm.tables import table
from tessera.runtime import materialize, new_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("hash"))
    # two passes, so that a worker holds one vocabulary's tables at a time
    counts = materialize(word_counts(docs, WORDS, "words").drop("text"), "rollup-words")
    other = materialize(byte_counts(docs, BYTES, public_tokenizers.PATTERN, "bytes").drop("text"), "rollup-bytes")
    # equal texts meet through a table of those texts only that come more than once
    first = materialize(other.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null"), "rollup-first")
    copies = other.join(small(first.select("hash", "first"), first), "hash").filter("not doc_id <=> first")
    rollup = Rollup(spark, new_path(spark, "rollup"))
    n, m = F.col("words"), F.col("bytes")
    rollup.commit("insert words", inserts(counts, "word_bpe_49k", n))
    rollup.commit("insert bytes", inserts(other, "byte_bpe_50k", m))
    rollup.compact()
    rollup.commit("revise words", revisions(counts, "word_bpe_49k", n, n + 1))
    rollup.commit("delete copies", deletes(copies, "byte_bpe_50k", m))
    rollup.commit("insert bytes", inserts(other, "byte_bpe_50k", m))  # a batch that comes twice counts once
    return rollup.totals()
