"""op7: all documents packed into sequences of 4096 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.packing import pack
from tessera.llm.tables import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), TOKENIZER)
