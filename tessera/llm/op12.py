"""op12: spelling variants of the words of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.spelling import spelling_groups
from tessera.llm.tables import table


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))
