"""op13: ``documents`` without the long strings that occur earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.repeats import remove_repeats
from tessera.llm.tables import table


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
