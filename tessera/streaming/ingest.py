"""Incremental ingest as streams.

The store has no event-time windows; the windowed counts over events are an
addition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from tessera.operators.messages import EVERY, sweep_drawers


def message_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 1) -> DataFrame:
    """New files of messages below a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sweep_into(stream: DataFrame, add: Callable[[DataFrame], object], checkpoint: str):
    """Start a query that gives each batch of messages to ``add`` as drawers.

    ``add`` keeps only ids that are new, so a batch that is run again after a
    failure adds nothing.
    """
    return stream.writeStream.foreachBatch(lambda batch, _: add(sweep_drawers(batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, ident: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose id is new within a delay of event time; older ids are forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([ident])


def windowed_counts(events: DataFrame, size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events and values by window and type; late rows beyond the delay don't count."""
    by = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("window.start", "window.end", "event_type", "n", "value")


class SaveTrigger(StatefulProcessor):
    """Emits (session, at) each time a session's messages reach a multiple."""

    def __init__(self, every: int = EVERY):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        before = self.seen.get()[0] if self.seen.exists() else 0
        now = before + sum(len(r) for r in rows)
        self.seen.update((now,))
        marks = list(range((before // self.every + 1) * self.every, now + 1, self.every))
        yield pd.DataFrame({"session": [key[0]] * len(marks), "at": marks})

    def close(self) -> None:
        pass


def save_triggers(stream: DataFrame, every: int = EVERY) -> DataFrame:
    """When sessions of a stream are due to be saved."""
    return stream.groupBy("session").transformWithStateInPandas(SaveTrigger(every), "session long, at long", "Append", "None")
