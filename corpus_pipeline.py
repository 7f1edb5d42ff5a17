"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import op1, op7
from tessera.llm.language import judged
from tessera.llm.mixing import repeated
from tessera.llm.ngram_join import ngram_groups
from tessera.llm.packing import pack
from tessera.llm.pii import mask
from tessera.llm.small import small
from tessera.llm.tables import table, unused
from tessera.runtime import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with a narrow margin, go.

    Null, empty and letterless texts have no language.  Rows are judged one by
    one, so repeated rows, null ids and columns of any name stay as they are; an
    empty table gives none.
    """
    verdict = unused(docs, "verdict")
    return judged(docs, op1.model_of(docs), verdict).filter(~F.col(verdict)["rejected"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at 0.8, the smallest doc_id stays.

    A document without words, or without an id, has no links and stays.  Rows
    that repeat an id are one document: all of them stay or go.  Columns of any
    name stay; an empty table gives none.
    """
    copies = ngram_groups(docs, n=5, num=80, den=100).filter("component_id <> doc_id").select(F.col("doc_id").alias("copy")).distinct()
    copies = small(materialize(copies, "pipeline-copies"))
    mine = docs.select(F.struct("*").alias("d"))
    return mine.join(copies, F.col("d.doc_id") == F.col("copy"), "left_anti").select("d.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows.

    A null text stays null with the n_chars it had; rows, repeated rows, null
    ids and columns of any name stay; an empty table gives none.
    """
    out = mask(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of their sources takes them.

    Labelled documents teach the weights.  Texts without words are size 0 and come once an epoch; a null source is a
    source of its own; rows that repeat an id are drawn together.  Columns of
    any name stay; an empty table gives none.
    """
    return repeated(docs, table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens.

    A null text is the end id alone; a null source is a queue of its own; each
    of repeated rows is packed; an empty table gives none.
    """
    return pack(docs, op7.TOKENIZER, slots=1 << 19)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: Compression, trained tokenizers and sampling by hash have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns what the last one does."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
