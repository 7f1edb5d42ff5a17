"""op9: all documents written as token shards and read back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.tables import table
from tessera.llm.token_files import read_shards, write_shards
from tessera.runtime import new_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-shards")
    write_shards(table(spark, sf_dir, "documents"), TOKENIZER, path)
    return read_shards(spark, path)
