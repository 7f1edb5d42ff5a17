"""op1: language of every document, learned from the rows that are not held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.language import LanguageModel, identify, train
from tessera.llm.tables import table


def held_out() -> Column:
    """Whether a document is in the held-out third; one without an id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def model_of(docs: DataFrame) -> LanguageModel:
    """The model that the rows outside the held-out third teach."""
    return train(docs.filter(~held_out()).select("doc_id", "text", "lang"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model_of(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")
