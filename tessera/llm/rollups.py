"""Token totals kept by signed changes.

A batch of changes is summed by source, language and tokenizer version and
written once under its own name.  Totals are those of the last compaction and
the sum of what was committed since; committing a name again changes nothing, so
a job may be run again from any point.
"""

from __future__ import annotations

from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.arrow import claim, slices, small_batches
from tessera.llm.tokenizer import encoder

#: Files of a batch or a compaction at most.
FILES = 8
_RANKS: dict[tuple[str, str], object] = {}

KEYS = ["source", "lang", "version"]
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"


def _byte_pairs(path: str, pattern: str):
    """The encoding of a file of ranks, kept by a worker."""
    import base64

    import tiktoken

    claim("byte-pairs", _RANKS.clear)
    if (path, pattern) not in _RANKS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _RANKS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _RANKS[path, pattern]


def word_counts(docs: DataFrame, path: str, name: str, slots: int = 1 << 20) -> DataFrame:
    """Add the number of ids of ``text`` by a file of the ``tokenizers`` library as ``name``; a null text has none."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        enc = encoder(path, slots)
        return pa.array([n for a, b in slices(texts) for n in enc.encode(texts.slice(a, b - a))[1].tolist()], pa.int64())

    return docs.withColumn(name, count(F.col("text")))


def byte_counts(docs: DataFrame, path: str, pattern: str, name: str) -> DataFrame:
    """Add the number of ids of ``text`` by a file of byte pair ranks as ``name``; a null text has none."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        enc = _byte_pairs(path, pattern)
        return pa.array([len(enc.encode_ordinary(t)) if t else 0 for a, b in slices(texts) for t in texts.slice(a, b - a).to_pylist()], pa.int64())

    return docs.withColumn(name, count(F.col("text")))


def inserts(counts: DataFrame, version: str, tokens: Column) -> DataFrame:
    """Changes that add the documents of ``counts`` (source, lang)."""
    return counts.select("source", "lang", F.lit(version).alias("version"), F.lit(1).alias("sign"), tokens.cast("long").alias("tokens"))


def deletes(counts: DataFrame, version: str, tokens: Column) -> DataFrame:
    """Changes that take the documents of ``counts`` away."""
    return counts.select("source", "lang", F.lit(version).alias("version"), F.lit(-1).alias("sign"), tokens.cast("long").alias("tokens"))


def revisions(counts: DataFrame, version: str, old: Column, new: Column) -> DataFrame:
    """Changes that replace the counts of documents: the old ones out, the new in."""
    return deletes(counts, version, old).unionAll(inserts(counts, version, new))


class Rollup:
    """The totals below one folder.

    ``batch=<name>`` holds the summed changes of a batch, ``base=<n>`` the totals
    and the names of all batches up to a compaction.  A folder counts once its
    mark is written, which comes last, so a lost job leaves nothing by halves.
    One job writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _names(self, kind: str, mark: str) -> list[str]:
        fs, target = self._fs(self.path)
        if not fs.exists(target):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        found = [n.removeprefix(f"{kind}=") for n in names if n.startswith(f"{kind}=")]
        return sorted(n for n in found if fs.exists(self._fs(f"{self.path}/{kind}={n}/{mark}")[1]))

    def _base(self) -> tuple[str | None, set[str]]:
        """The folder of the last compaction, and the names it holds."""
        made = self._names("base", "DONE")
        if not made:
            return None, set()
        path = f"{self.path}/base={max(made, key=int)}"
        return path, {r["name"] for r in self.spark.read.schema("name string").parquet(f"{path}/names").collect()}

    def _folder(self, batch: str) -> str:
        return f"{self.path}/batch={quote(batch, safe='')}"

    def committed(self, batch: str) -> bool:
        """Whether a batch of this name is whole."""
        fs, target = self._fs(f"{self._folder(batch)}/_SUCCESS")
        return fs.exists(target) or batch in self._base()[1]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add ``changes`` (source, lang, version, sign, tokens) under a name of any characters.

        Returns whether anything was written; a name that is committed is left
        alone, and one that a lost job left in part is written anew.  Null
        sources and languages are keys of their own; null counts are 0.  Rows
        are summed before they are moved, so a hot key is one row a task.
        """
        if self.committed(batch):
            return False
        tokens = F.coalesce("tokens", F.lit(0))
        delta = changes.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * tokens).alias("n_tokens"))
        delta.coalesce(FILES).write.mode("overwrite").parquet(self._folder(batch))
        return True

    def batches(self) -> list[str]:
        """Names of the committed batches, compacted ones included."""
        return sorted({unquote(n) for n in self._names("batch", "_SUCCESS")} | self._base()[1])

    def compact(self) -> None:
        """Sum what is committed into one table; doing it again changes nothing.

        The new base counts from its mark on; then the folders it holds go, and
        those that a lost job leaves go with the next compaction.
        """
        base, held = self._base()
        fresh = [unquote(n) for n in self._names("batch", "_SUCCESS")]
        if set(fresh) - held:
            n = max([int(x) for x in self._names("base", "DONE")], default=0) + 1
            path = f"{self.path}/base={n}"
            self.totals().coalesce(FILES).write.mode("overwrite").parquet(f"{path}/totals")
            names = [(x,) for x in sorted(held | set(fresh))]
            self.spark.createDataFrame(names, "name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")
            fs, mark = self._fs(f"{path}/DONE")
            fs.create(mark, True).close()
        now, held = self._base()
        for name in fresh:
            if name in held:
                fs, target = self._fs(self._folder(name))
                fs.delete(target, True)
        for n in self._names("base", "DONE"):
            if f"{self.path}/base={n}" != now:
                fs, target = self._fs(f"{self.path}/base={n}")
                fs.delete(target, True)

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and version.

        Keys whose documents and tokens are all gone are left out; without a
        committed batch there are none.
        """
        base, held = self._base()
        paths = [self._folder(b) for b in (unquote(n) for n in self._names("batch", "_SUCCESS")) if b not in held]
        paths += [f"{base}/totals"] if base else []
        if not paths:
            return self.spark.createDataFrame([], DELTA)
        summed = self.spark.read.schema(DELTA).parquet(*paths).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.filter("n_docs <> 0 or n_tokens <> 0")
