"""op11: a Merkle manifest of ``documents``, with proofs and a tampered copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.merkle import manifest
from tessera.llm.tables import table


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))
