"""Sources that others add.

A source names itself, its version, its modes and its columns, and yields
records.  The registry finds one by name; as a Spark data source it is read by
``spark.read.format(name)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The columns of a record of any source.
RECORD = "source_file string, chunk_index int, content string, metadata map<string,string>"
#: Kinds of metadata fields, and how a text is checked to be of one.
KINDS = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "json": "variant"}


class Adapter(DataSource):
    """A source; subclasses give ``label``, ``version``, ``modes``, ``fields`` and ``records``."""

    label, version, modes, fields = "", "0", ("full",), {}

    @classmethod
    def name(cls) -> str:
        return cls.label

    def schema(self) -> str:
        return RECORD

    def parts(self) -> list[Any]:
        """What can be read apart, one task each."""
        return [None]

    def records(self, part: Any) -> Iterator[tuple]:
        """Rows of one part, as the columns of ``RECORD``."""
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, adapter: Adapter):
        self.adapter = adapter

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.adapter.parts()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.adapter.records(partition.value)


class Registry:
    """Adapters by name; an explicit name goes before a configured one, then files."""

    def __init__(self, spark: SparkSession, fallback: str = "filesystem"):
        self.spark, self.fallback, self.known = spark, fallback, {}

    def add(self, adapter: type[Adapter]) -> None:
        if not adapter.label or adapter.label in self.known:
            raise ValueError(f"adapter name: {adapter.label!r}")
        self.known[adapter.label] = adapter
        self.spark.dataSource.register(adapter)

    def names(self) -> list[str]:
        return sorted(self.known)

    def resolve(self, explicit: str | None = None, configured: str | None = None) -> str:
        name = explicit or configured or self.fallback
        if name not in self.known and name != self.fallback:
            raise KeyError(f"no adapter {name!r}; known: {self.names()}")
        return name

    def read(self, name: str, **options: str) -> DataFrame:
        return self.spark.read.format(self.resolve(name)).options(**options).load()


def conforming(records: DataFrame, fields: dict[str, str], required: list[str] = []) -> DataFrame:
    """Records with a text, whose metadata has the required fields, each of its kind."""
    good = F.octet_length(F.coalesce("content", F.lit(""))) > 0
    for name, kind in fields.items():
        value = F.col("metadata")[name]
        parsed = F.try_parse_json(value).isNotNull() if kind == "json" else value.try_cast(KINDS[kind]).isNotNull()
        good = good & (value.isNull() | parsed)
    for name in required:
        good = good & F.col("metadata")[name].isNotNull()
    return records.filter(F.coalesce(good, F.lit(False)))


def is_filed(drawers: DataFrame, source: str, chunk: int) -> bool:
    """Whether a chunk of a source is stored."""
    return bool(drawers.filter((F.col("source_file") == source) & (F.col("chunk_index") == chunk)).limit(1).count())


def count_filed(drawers: DataFrame, source: str) -> int:
    """Stored chunks of a source."""
    return drawers.filter(F.col("source_file") == source).count()
