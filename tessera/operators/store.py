"""Tables of the store as versions in a folder.

Parquet files aren't changed in place.  A version of a table is a list of
folders; a mutation writes a new folder, beside the old ones or instead of them,
and then moves the pointer, so readers see one version or the other, and a job
that is lost in between leaves the old one.  Drawers and their postings move
under one pointer, and so do facts and entities.  A writer names the version that it started from and fails if
another has moved on since, so no update is lost.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.functions.text import content_id
from tessera.operators import index

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()
_of = lambda **kinds: T.StructType([T.StructField(k, v) for k, v in kinds.items()])
#: The tables and their columns.
SCHEMAS = {
    "drawers": _of(id=_S, wing=_S, room=_S, content=_S, source_file=_S, chunk_index=_I, added_by=_S, ingest_mode=_S, extract_mode=_S, source_mtime=_D, filed_at=_TS),
    "drawer_words": _of(word=_S, id=_S, n=_L),
    "entities": _of(id=_S, name=_S, type=_S, properties=_S, created_at=_TS),
    "triples": _of(id=_S, subject=_S, predicate=_S, object=_S, valid_from=_S, valid_to=_S, confidence=_D, source_closet=_S, source_file=_S, source_drawer_id=_S, adapter_name=_S, extracted_at=_TS),
    "compressed": _of(id=_S, content=_S, compression_ratio=_D, wing=_S, room=_S, source_file=_S, filed_at=_TS),
    "explicit_tunnels": _of(id=_S, source_wing=_S, source_room=_S, target_wing=_S, target_room=_S, source_drawer_id=_S, target_drawer_id=_S, label=_S, kind=_S, created_at=_TS, updated_at=_TS),
}


#: Tables that share the pointer of another.
TOGETHER = {"drawer_words": "drawers", "entities": "triples"}
#: Folders of a table after which an append writes it anew as one.
FOLDERS = 32


class Store:
    """The tables below a folder, each with a pointer to its current version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _pointers(self, name: str) -> str:
        return f"{self.root}/{TOGETHER.get(name, name)}/_pointer"

    def version(self, name: str) -> int:
        """The current version of a table; 0 if it was never written."""
        fs, folder = self._fs(self._pointers(name))
        if not fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), default=0)

    def _state(self, name: str, version: int) -> dict:
        """Folders and rows of the tables under the pointer of ``name``."""
        if version == 0:
            return {}
        fs, pointer = self._fs(f"{self._pointers(name)}/{version}")
        stream = fs.open(pointer)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A version of a table, by default the current one; empty if there is none."""
        at = self.version(name) if version is None else version
        folders = self._state(name, at).get(name, {}).get("folders", [])
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{name}/{f}" for f in folders])

    def rows(self, name: str) -> int:
        """Rows of the current version by the count that its writer left."""
        return self._state(name, self.version(name)).get(name, {}).get("rows", 0)

    def _put(self, name: str, rows: DataFrame) -> tuple[str, DataFrame]:
        """Write ``rows`` as a folder of a table; columns that they lack are null."""
        have = set(rows.columns)
        shaped = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])
        folder = f"data-{uuid.uuid4().hex}"
        shaped.write.parquet(f"{self.root}/{name}/{folder}")
        return folder, self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/{folder}")

    def _move(self, name: str, base: int, tables: dict[str, dict]) -> int:
        """Make ``tables`` (name to folders and rows) the version after ``base``."""
        state = self._state(name, base) | tables
        fs, pointer = self._fs(f"{self._pointers(name)}/{base + 1}")
        out = fs.create(pointer, False)  # fails if the version exists, so one of two writers wins
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        return base + 1

    def write(self, name: str, rows: DataFrame, base: int | None = None) -> int:
        """Make ``rows`` the current version.

        ``base`` is the version that the rows were made from; if another writer
        has moved on since, nothing changes and an error is raised.
        """
        base = self.version(name) if base is None else base
        folder, kept = self._put(name, rows)
        return self._move(name, base, {name: {"folders": [folder], "rows": kept.count()}})

    def append(self, base: int, **parts: DataFrame) -> int:
        """Add rows to tables of one pointer, made from version ``base``, as folders beside the old ones."""
        return self._extend(base, {name: self._put(name, rows) for name, rows in parts.items()})

    def _extend(self, base: int, parts: dict[str, tuple[str, DataFrame]]) -> int:
        first = next(iter(parts))
        state, tables = self._state(first, base), {}
        for name, (folder, kept) in parts.items():
            old = state.get(name, {"folders": [], "rows": 0})
            tables[name] = {"folders": [*old["folders"], folder], "rows": old["rows"] + kept.count()}
            if len(tables[name]["folders"]) > FOLDERS:
                whole = self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/{name}/{f}" for f in tables[name]["folders"]])
                tables[name]["folders"] = [self._put(name, whole)[0]]
        return self._move(first, base, tables)

    def change(self, name: str, how: Callable[[DataFrame], DataFrame]) -> int:
        """Write what ``how`` makes of the current version."""
        base = self.version(name)
        return self.write(name, how(self.read(name, base)), base)

    def add_drawers(self, rows: DataFrame, base: int | None = None) -> int:
        """Append drawers whose id is new, and their postings, at once; returns how many.

        Nothing that is stored is written again; the ids alone are read.
        """
        base = self.version("drawers") if base is None else base
        folder, new = self._put("drawers", rows.dropDuplicates(["id"]).join(self.read("drawers", base).select("id"), "id", "left_anti"))
        added = new.count()
        if added:
            words = self._put("drawer_words", index.build_postings(new.select("id", "content")))
            self._extend(base, {"drawers": (folder, new), "drawer_words": words})
        return added

    def exchange_drawers(self, gone: DataFrame, rows: DataFrame, base: int) -> int:
        """Delete the drawers of ``gone`` (id) and add those of ``rows`` whose id is new, in one version.

        Both were made from version ``base``; a writer that has moved on since
        makes it fail, and until the pointer moves all readers see the old state.
        Returns the drawers added.
        """
        if not gone.limit(1).count():
            return self.add_drawers(rows, base)
        ids = gone.select("id")
        kept = [self._put(name, self.read(name, base).join(ids, "id", "left_anti")) for name in ("drawers", "drawer_words")]
        new = self._put("drawers", rows.dropDuplicates(["id"]).join(kept[0][1].select("id"), "id", "left_anti"))
        words = self._put("drawer_words", index.build_postings(new[1].select("id", "content")))
        parts = {"drawers": (kept[0], new), "drawer_words": (kept[1], words)}
        added = new[1].count()
        self._move("drawers", base, {name: {"folders": [f for f, _ in both], "rows": sum(df.count() for _, df in both)} for name, both in parts.items()})
        return added

    def add_contents(self, rows: DataFrame) -> int:
        """Append drawers (wing, room, content) under ids by what they hold."""
        return self.add_drawers(rows.withColumn("id", content_id(F.col("wing"), F.col("room"), F.col("content"))))

    def update_drawers(self, patch: DataFrame) -> DataFrame:
        """Apply ``patch`` (id, wing, room, content; null keeps) and return the ids refused.

        A drawer's id follows what it holds; a change whose new id belongs to
        another drawer is refused.
        """
        base = self.version("drawers")
        old = self.read("drawers", base)
        p = patch.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("wing", "room", "content")])
        merged = old.join(p, old.id == p._id).select(old.id.alias("old_id"), *[F.coalesce(f"_{c}", c).alias(c) for c in ("wing", "room", "content")], *[c for c in old.columns if c not in ("id", "wing", "room", "content")])
        merged = merged.withColumn("id", content_id(F.col("wing"), F.col("room"), F.col("content")))
        taken = merged.join(old.select(F.col("id").alias("id")), "id", "left_semi").filter("id <> old_id").select("old_id")
        good = merged.join(taken, "old_id", "left_anti").dropDuplicates(["id"])
        refused = taken.collect()
        gone = good.select(F.col("old_id").alias("id"))
        words = self.read("drawer_words", base).join(gone, "id", "left_anti").unionByName(index.build_postings(good.select("id", "content")))
        after = old.join(gone, "id", "left_anti").unionByName(good.drop("old_id"))
        self._replace(base, drawers=after, drawer_words=words)
        return self.spark.createDataFrame([(r[0],) for r in refused], "id string")

    def delete_drawers(self, ids: DataFrame) -> None:
        """Delete drawers and their postings at once."""
        base = self.version("drawers")
        self._replace(base, **{name: self.read(name, base).join(ids.select("id"), "id", "left_anti") for name in ("drawers", "drawer_words")})

    def _replace(self, base: int, **parts: DataFrame) -> int:
        """Write tables of one pointer, made from version ``base``, anew."""
        tables = {}
        for name, rows in parts.items():
            folder, kept = self._put(name, rows)
            tables[name] = {"folders": [folder], "rows": kept.count()}
        return self._move(next(iter(parts)), base, tables)

    def rebuild_index(self) -> int:
        """Make the postings anew from the drawers, unless fewer drawers are read than their writer counted."""
        base = self.version("drawers")
        drawers = self.read("drawers", base)
        if not index.rebuild_is_safe(drawers.count(), self._state("drawers", base).get("drawers", {}).get("rows", 0)):
            raise ValueError("fewer drawers were read than are stored")
        return self.write("drawer_words", index.build_postings(drawers.filter("content <> ''").select("id", "content")), base)

    def prune(self, buckets: DataFrame) -> DataFrame:
        """Delete drawers that ``buckets`` (id, bucket) calls missing or ignored; counts by bucket."""
        gone = buckets.filter(F.col("bucket").isin("missing", "gitignored")).select("id")
        counts = buckets.groupBy("bucket").agg(F.count("*").alias("n"))
        self.delete_drawers(gone)
        return counts
