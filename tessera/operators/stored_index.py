"""A keyword index that is written once and read by the words asked for.

Postings lie in folders by a checksum of their word and, within a file, in the
order of words, so that a search opens the folders of its words and skips the row
groups of others.  A posting carries the length and the place of its drawer, so
candidates, term counts and lengths come from the same few files.  The drawers
themselves lie in folders by a checksum of their file, in the order of chunks.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tessera.functions.text import query_tokens, tokens
from tessera.operators import search
from tessera.operators.index import counted

#: Drawers for each folder of postings or of drawers, and the folders that there are at least and at most.
DRAWERS_PER_FOLDER, LEAST, MOST = 256, 8, 4096
#: Columns of a drawer that its postings carry.
CARRIED = ("wing", "room", "source_file", "chunk_index")


def _folder(key: Column, folders: int) -> Column:
    return (F.crc32(key.cast("binary")) % folders).cast("int")


class SearchIndex:
    """The index below ``root``; ``build`` writes it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        about = spark.read.parquet(f"{root}/about").first()
        self.folders = about["folders"]
        # an index of no drawers has no file that could tell its columns
        self.postings, self.drawers = (spark.read.schema(T.StructType.fromJson(json.loads(about[name]))).parquet(f"{root}/{name}") for name in ("postings", "drawers"))

    @classmethod
    def build(cls, drawers: DataFrame, root: str, folders: int | None = None) -> SearchIndex:
        """Write the index of ``drawers`` (id, content, wing, room, source_file, chunk_index, ...).

        Ids are unique.  Empty and null contents have no postings; a null file
        counts as an empty one.  Folders that hold a hot word are split into
        several files as they are dealt.
        """
        spark = drawers.sparkSession
        if folders is None:
            folders = LEAST
            wanted = drawers.count() // DRAWERS_PER_FOLDER
            while folders < min(wanted, MOST):
                folders *= 2
        base = drawers.select("id", *CARRIED, tokens(F.col("content")).alias("ts")).withColumn("length", F.size("ts").cast("long"))
        each = counted(base, "ts").select("word", "id", *CARRIED, "length", "n")
        each = each.withColumn("folder", _folder(F.col("word"), folders)).hint("rebalance", "folder")
        each.sortWithinPartitions("folder", "word", "id").write.partitionBy("folder").parquet(f"{root}/postings")
        whole = drawers.withColumn("folder", _folder(F.coalesce("source_file", F.lit("")), folders)).hint("rebalance", "folder")
        whole.sortWithinPartitions("folder", "source_file", "chunk_index").write.partitionBy("folder").parquet(f"{root}/drawers")
        about = [(folders, each.schema.json(), whole.schema.json())]
        spark.createDataFrame(about, "folders int, postings string, drawers string").coalesce(1).write.parquet(f"{root}/about")
        return cls(spark, root)

    def rows_of(self, words: list[str]) -> DataFrame:
        """The postings of some words; only their folders are read."""
        some = sorted(set(words))
        places = sorted({zlib.crc32(w.encode()) % self.folders for w in some})
        return self.postings.filter(F.col("folder").isin(places) & F.col("word").isin(some)).drop("folder")

    def search(self, query: str, n: int, wing: str | None = None, room: str | None = None, people: list[str] = []) -> DataFrame:
        """The ``n`` most relevant drawers, as ``search.bm25_search`` ranks them.

        Returns id, wing, room, source_file, chunk_index and relevance; a query
        without words gives no row.
        """
        words = query_tokens(query)
        if not words:
            return self.postings.select("id", *CARRIED).withColumn("relevance", F.lit(0.0)).limit(0)
        words += [w for w in dict.fromkeys(w for p in people for w in query_tokens(p)) if w not in words]
        mine = self.rows_of(words)
        for name, value in (("wing", wing), ("room", room)):
            if value is not None:
                mine = mine.filter(F.col(name) == value)
        pool = mine.groupBy("id").agg(F.sum("n").alias("tf"), F.max("length").alias("len")).orderBy(F.desc("tf"), "id").limit(n * search.OVERFETCH)
        # both windows see as many rows as the limit has, or that many for each word
        pool = pool.select("id", F.count("*").over(W.partitionBy()).alias("total"), F.avg("len").over(W.partitionBy()).alias("avgdl"))
        terms = mine.join(F.broadcast(pool), "id").withColumn("df", F.count("*").over(W.partitionBy("word")))
        asked = F.create_map(*[F.lit(x) for w, k in Counter(words).items() for x in (w, float(k))])
        idf = F.ln((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        norm = 1 - search.B + search.B * F.col("length") / F.col("avgdl")
        part = asked[F.col("word")] * idf * F.col("n") * (search.K1 + 1) / (F.col("n") + search.K1 * norm)
        best = terms.groupBy("id", *CARRIED).agg(F.sum(part).alias("relevance"))
        return best.orderBy(F.desc("relevance"), "id").limit(n)

    def _in_files(self, rows: DataFrame, *on: str) -> DataFrame:
        """Drawers that ``rows`` name by file, and by the other columns of ``on``; only the folders of those files are read."""
        named = rows.withColumn("folder", _folder(F.col("source_file"), self.folders))
        return self.drawers.join(F.broadcast(named), ["folder", "source_file", *on]).drop("folder")

    def neighbours(self, anchors: DataFrame, radius: int) -> DataFrame:
        """Chunks within ``radius`` of each of a few anchors (id, source_file, chunk_index), themselves left out.

        ``anchors`` are the results of a search, as many as it was asked for.
        """
        a = anchors.filter("source_file <> ''").select(F.col("id").alias("anchor"), "source_file", F.col("chunk_index").alias("at"))
        near = a.withColumn("chunk_index", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - radius), F.col("at") + radius))).filter("chunk_index <> at")
        return self._in_files(near.drop("at").withColumn("chunk_index", F.col("chunk_index").cast(self.drawers.schema["chunk_index"].dataType)), "chunk_index")

    def files_of(self, results: DataFrame) -> DataFrame:
        """All drawers of the files of a search's results."""
        return self._in_files(results.filter("source_file <> ''").select("source_file").distinct())

    def contents_of(self, results: DataFrame) -> DataFrame:
        """Results with all columns of their drawers."""
        mine = results.select("id", F.coalesce("source_file", F.lit("")).alias("_file"), "relevance")
        named = mine.withColumn("folder", _folder(F.col("_file"), self.folders)).drop("_file")
        return self.drawers.join(F.broadcast(named), ["folder", "id"]).drop("folder").orderBy(F.desc("relevance"), "id")

    def check_duplicate(self, content: str, least: float = 3.0) -> DataFrame:
        """Drawers that a content finds with a relevance above ``least``, five at most."""
        return self.search(content, 5).filter(F.col("relevance") > least)

    def doc_lengths(self) -> DataFrame:
        """Tokens of each drawer that has any."""
        return self.postings.groupBy("id").agg(F.max("length").alias("length"))
