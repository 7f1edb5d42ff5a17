"""op6: all documents mixed to the weights of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.mixing import mix
from tessera.llm.tables import table


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, table(spark, sf_dir, "labels")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
