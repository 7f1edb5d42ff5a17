"""Project files as drawers, from the listing to the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.text import content_id
from tessera.operators import chunk
from tessera.operators.store import Store
from tessera.runtime import scratch
from tessera.sources import files


def drawers_of(found: DataFrame, wing: str, rooms: list[tuple[str, list[str]]], agent: str = "miner") -> DataFrame:
    """Chunks of ``found`` (path, relative, mtime, content) as drawers of their rooms.

    An id follows the wing, the room, the file, the place and the text, so the
    same files give the same drawers; equal chunks of a file stay apart.
    """
    room = chunk.file_room(F.col("relative"), F.col("content"), rooms)
    rows = found.select("path", "mtime", room.alias("room"), F.inline(chunk.chunk_text(F.col("content"))))
    ident = content_id(F.lit(wing), F.col("room"), F.concat_ws("\u001f", "path", F.col("chunk_index").cast("string"), "content"))
    return rows.select(ident.alias("id"), F.lit(wing).alias("wing"), "room", "content", F.col("path").alias("source_file"), "chunk_index", F.lit(agent).alias("added_by"), F.lit("project").alias("ingest_mode"), F.col("mtime").alias("source_mtime"), F.current_timestamp().alias("filed_at"))


def mine(store: Store, root: str, wing: str, rooms: list[tuple[str, list[str]]], patterns: list[str] = [], agent: str = "miner") -> int:
    """Read the files below ``root`` that changed since they were read; returns the drawers added.

    Drawers of a changed file that it no longer gives go in the same version of
    the store as the new ones come; files are read once.
    """
    base = store.version("drawers")
    stored = store.read("drawers", base).filter(F.col("wing") == wing)
    fresh = stored.groupBy("source_file").agg(F.max("source_mtime").alias("mtime"))
    with scratch(store.spark) as keep:
        found = keep(files.not_yet_read(files.readable(files.scan(store.spark, root, patterns=patterns)), fresh), "mine-files")
        new = keep(drawers_of(found, wing, rooms, agent), "mine-drawers")
        stale = keep(stored.join(found.select(F.col("path").alias("source_file")), "source_file", "left_semi").join(new.select("id"), "id", "left_anti").select("id"), "mine-stale")
        return store.exchange_drawers(stale, new, base)
