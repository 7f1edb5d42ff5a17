"""Writing documents as token shards in id order, and reading them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessera.llm.arrow import release, slices, small_batches
from tessera.llm.repair import Shard, compress
from tessera.llm.small import small
from tessera.llm.tokenizer import encoder

#: Ids after which a shard is closed, at the end of a document.
SHARD_TOKENS = 1 << 19
SHARDS = "part long, shard long, base long, n_tokens long, doc_ids array<long>, data binary"


def write_shards(docs: DataFrame, tokenizer: str, path: str, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write ``docs`` (doc_id, text) as shards in ascending order of doc_id.

    Rows are dealt by ranges of doc_id and sorted within; rows that repeat an id
    stand in the order of their texts, null ids first.  A shard is a row of a
    Parquet table, so a task that runs again replaces its own files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        held_ids: list = []
        held, lens = [], []
        count = base = shard = 0

        def close() -> pa.RecordBatch:
            data = compress(np.concatenate(held), np.concatenate(lens), enc.size)
            row = [[part], [shard], [base], [count], [held_ids], [data]]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["part", "shard", "base", "n_tokens", "doc_ids", "data"])

        for batch in batches:
            for a, b in slices(batch.column("text")):
                rows = batch.slice(a, b - a)
                flat, n = enc.encode_with_end(rows.column("text"))
                held_ids += rows.column("doc_id").to_pylist()
                held.append(flat)
                lens.append(n)
                count += len(flat)
                if count >= shard_tokens:
                    yield close()
                    base, shard = base + count, shard + 1
                    held_ids, held, lens, count = [], [], [], 0
        if held:
            yield close()

    small_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARDS).write.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents of the shards."""
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = shards.join(small(parts.select("part", before.alias("before")), parts), "part").select((F.col("before") + F.col("base")).alias("start"), "doc_ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column("data")[i].as_py())
                flat, n = shard.all().astype("<u4", copy=False), shard.doc_lens
                ends = np.cumsum(n)
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                start = batch.column("start")[i].as_py() + ends - n
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("doc_ids")[i].as_py(), pa.int64()), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                del shard, flat, view
                release()

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
