"""A Merkle tree over the rows of a table, by source, with a proof for every row.

Rows become leaves in the order of their ids.  A task walks an aligned block of
leaves in postorder: each subtree returns its digest and, while the walk unwinds,
its siblings are appended to the leaves that it holds.  The roots of the blocks
are the leaves of the next traversal, which is distributed in the same way, until
a source has one node; the sources' roots are the leaves of a last tree.  Paths
then go back down, from a block's root to the leaves of the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.llm.small import small
from tessera.runtime import materialize, scratch

#: Nodes of a run, and the levels that a task walks at a time.
FAN, HEIGHT = 3, 6
BLOCK = FAN**HEIGHT
#: The columns of a leaf in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels that a task walks in a tree whose present level has ``n`` nodes."""
    k = 0
    while FAN**k < n and k < HEIGHT:
        k += 1
    return k


def visit(nodes: list[str], lo: int, height: int, paths: list[list[str]] | None = None) -> str:
    """The digest of the subtree over ``nodes`` from ``lo``, FAN ** ``height`` of them at most.

    Every contained leaf gets, for each level from below, the siblings on its
    left, a point, those on its right and a stroke.
    """
    if height == 0:
        return nodes[lo]
    step = FAN ** (height - 1)
    starts = range(lo, min(lo + FAN * step, len(nodes)), step)
    digests = [visit(nodes, a, height - 1, paths) for a in starts]
    if paths is not None:
        for i, a in enumerate(starts):
            level = f"{''.join(digests[:i])}.{''.join(digests[i + 1 :])}/"
            for leaf in range(a, min(a + step, len(nodes))):
                paths[leaf].append(level)
    return digest("".join(digests))


def folded(leaf: str, path: str) -> str:
    """The root that follows from a leaf and its path."""
    for level in path.split("/")[:-1]:
        left, right = level.split(".")
        leaf = digest(left + leaf + right)
    return leaf


def leaf_digest(values: dict[str, Column]) -> Column:
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*[field(values[f]) for f in FIELDS]).cast("binary"), 256)


def numbered(keep: Callable[[DataFrame, str], DataFrame], df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``idx``, the place of a row in its group ``g``, and ``n``, the rows of the group.

    Rows are dealt by ranges, so that no group has to fit one task; places follow
    from the counts of the ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_pylist()
            first = np.array([True, *[a != b for a, b in zip(g, g[1:])]])
            at = np.arange(len(g))
            local = at - np.maximum.accumulate(np.where(first, at, 0))
            if g[0] == last:
                upto = int(np.argmax(first[1:])) + 1 if first[1:].any() else len(g)
                local[:upto] += count
            last, count = g[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(g), part)), pa.array(local)], names=[*batch.schema.names, "part", "local"])

    dealt = df.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    dealt = keep(dealt.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*df.dtypes, ("part", "long"), ("local", "long")])), name)
    counts = dealt.groupBy("g", "part").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = keep(counts.select("g", "part", before.alias("before"), F.sum("k").over(W.partitionBy("g")).alias("n")), f"{name}-counts")
    return dealt.join(small(counts), ["g", "part"]).withColumn("idx", F.col("before") + F.col("local")).drop("part", "local", "before")


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("idx")


def _climb(keep: Callable[[DataFrame, str], DataFrame], nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` (g, idx, n, digest) and the levels of block roots above them, up to one node a group."""

    def roots(key: tuple, table: pa.Table) -> pa.Table:
        table = _sorted(table)
        n = table.column("n")[0].as_py()
        root = visit(table.column("digest").to_pylist(), 0, height_of(n))
        return pa.table({"g": pa.array([key[0].as_py()]), "idx": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": pa.array([root])})

    levels = [nodes.select("g", "idx", "n", "digest")]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > 1:
        up = levels[-1].groupBy("g", F.floor(F.col("idx") / BLOCK).alias("block")).applyInArrow(roots, "g string, idx long, n long, digest string")
        levels.append(keep(up, f"{name}-{len(levels)}"))
    return levels


def _descend(nodes: DataFrame, parents: DataFrame, schema: str, rows: Callable[[pa.Table, list[str], pa.Table], pa.Table]) -> DataFrame:
    """``rows`` of the nodes of each block, their paths, and the parent (g, idx, path, subroot) of the block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = _sorted(left)
        digests = left.column("digest").to_pylist()
        paths: list[list[str]] = [[] for _ in digests]
        visit(digests, 0, height_of(left.column("n")[0].as_py()), paths)
        above = right.column("path")[0].as_py()
        return rows(left, ["".join(p) + above for p in paths], right)

    block = F.floor(F.col("idx") / BLOCK).alias("block")
    return nodes.groupBy("g", block).cogroup(parents.groupBy("g", "idx")).applyInArrow(run, schema)


_DOWN = "g string, idx long, path string, subroot string"


def _down(left: pa.Table, paths: list[str], right: pa.Table) -> pa.Table:
    return pa.table({"g": left.column("g"), "idx": left.column("idx"), "path": pa.array(paths), "subroot": pa.array([right.column("subroot")[0].as_py()] * len(paths), pa.string())})


def manifest(docs: DataFrame) -> DataFrame:
    """Digests, proofs and the check of a tampered copy for every row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns play no
    part.  Any of the five may be null, which differs from empty; a null source
    is a source of its own, first of all.  Rows that repeat an id stand in the
    order of their leaves, null ids first; equal rows have equal leaves at places
    of their own.  An empty table gives none.  Tampering leaves rows without an
    id alone.

    Returns doc_id, source, leaf, subroot, root, proof_sha256, folded_root and
    verified.
    """
    spark = docs.sparkSession
    values = {f: F.col(f) for f in FIELDS}
    g = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), "source"))
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = F.when(tampers & F.contains("text", F.lit("\n")), leaf_digest(values | {"text": F.replace("text", F.lit("\n"), F.lit(""))}))
    with scratch(spark) as keep:
        leaves = keep(docs.select("doc_id", "source", g.alias("g"), leaf_digest(values).alias("digest"), other.alias("other")), "merkle-leaves")
        leaves = keep(numbered(keep, leaves, ["doc_id", "digest"], "merkle-order"), "merkle-numbered")
        levels = _climb(keep, leaves, "merkle-level")
        subroots = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), "digest")
        tops = keep(numbered(keep, subroots, ["of"], "merkle-sources"), "merkle-tops")
        above = _climb(keep, tops, "merkle-top")
        root = above[-1].first()
        root = root["digest"] if root else ""
        # from the root down to the sources, and from their roots to the leaves
        down = above[-1].select("g", "idx", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"))
        for nodes in above[-2::-1]:
            down = _descend(nodes, down, _DOWN, _down)
        down = tops.join(down.select("idx", "path"), "idx").select(F.col("of").alias("g"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"))
        for nodes in levels[-2:0:-1]:
            down = _descend(nodes, down, _DOWN, _down)

        def finish(left: pa.Table, paths: list[str], right: pa.Table) -> pa.Table:
            found = [folded(a if b is None else b, p) for a, b, p in zip(left.column("digest").to_pylist(), left.column("other").to_pylist(), paths)]
            proofs = [digest(p.replace(".", "").replace("/", "")) for p in paths]
            n = len(paths)
            return pa.table({"doc_id": left.column("doc_id"), "source": left.column("source"), "leaf": left.column("digest"), "subroot": pa.array([right.column("subroot")[0].as_py()] * n), "root": pa.array([root] * n), "proof_sha256": pa.array(proofs), "folded_root": pa.array(found), "verified": pa.array([f == root for f in found])})

        kind = dict(docs.dtypes)["doc_id"]
        schema = f"doc_id {kind}, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return materialize(_descend(leaves, down, schema, finish), "merkle")
