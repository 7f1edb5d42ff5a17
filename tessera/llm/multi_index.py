"""Near-duplicate vectors through an inverted multi-index.

Two codebooks, one for each half of a unit vector, form a grid of cells.  A
vector is stored in the cell of its nearest codewords and looks for partners in
the cells that a multi-sequence traversal reaches first, nearest sum of squared
distances first; how many it visits follows from a target recall for the hardest
pairs that count.  What meets in a cell is verified by exact cosines in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.small import small
from tessera.llm.vectors import finite, hash_sample
from tessera.operators.components import connected_components
from tessera.runtime import materialize

#: Vectors and probes of a cell that one block compares.
MEMBERS, PROBES = 128, 384


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of the two halves, and the cells that a vector visits."""

    left: np.ndarray
    right: np.ndarray
    visits: int

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the codewords, up to a term of the vector."""
        half = self.left.shape[1]
        a, b = units[:, :half], units[:, half:]
        return (self.left**2).sum(1) - 2 * a @ self.left.T, (self.right**2).sum(1) - 2 * b @ self.right.T

    def home(self, units: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        a, b = self.distances(units)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def nearest(self, a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
        """The ``n`` nearest cells of one vector, by multi-sequence traversal."""
        i, j = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        queue, seen, out = [(a[i[0]] + b[j[0]], 0, 0)], {(0, 0)}, []
        while queue and len(out) < n:
            _, x, y = heapq.heappop(queue)
            out.append(i[x] * len(j) + j[y])
            for u, v in ((x + 1, y), (x, y + 1)):
                if u < len(i) and v < len(j) and (u, v) not in seen:
                    seen.add((u, v))
                    heapq.heappush(queue, (a[i[u]] + b[j[v]], u, v))
        return out


def _codebook(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    unique = np.unique(points, axis=0)
    words = unique[rng.choice(len(unique), min(k, len(unique)), replace=False)]
    for _ in range(rounds):
        near = ((words**2).sum(1) - 2 * points @ words.T).argmin(1)
        n = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, points)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def fit(sample: np.ndarray, words: int, least: float, recall: float, seed: int = 7) -> MultiIndex:
    """Codebooks of ``words`` words, and visits for the target ``recall``.

    Each sampled vector gets a partner at exactly the cosine ``least`` in a
    random direction, the hardest that counts; the visits are those after which
    the share ``recall`` of partners' cells is reached.
    """
    rng = np.random.default_rng(seed)
    half = (sample.shape[1] + 1) // 2
    index = MultiIndex(_codebook(sample[:, :half], words, rng), _codebook(sample[:, half:], words, rng) if sample.shape[1] > 1 else np.zeros((1, 0)), 1)
    other = rng.normal(size=sample.shape)
    other -= (other * sample).sum(1, keepdims=True) * sample
    other /= np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-12)
    a, b = index.distances(sample)
    at = index.home(least * sample + np.sqrt(1 - least * least) * other)
    away = a[np.arange(len(sample)), at // len(index.right)] + b[np.arange(len(sample)), at % len(index.right)]
    # cells nearer than the partner's, counted from the sorted half of each vector
    b = np.sort(b, axis=1)
    rank = np.array([int(np.searchsorted(y, z - x, side="left").sum()) for x, y, z in zip(a, b, away)])
    return MultiIndex(index.left, index.right, int(np.quantile(rank, recall, method="higher")) + 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; large components are scaled down first."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision, shorter ones filled with zeros."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lens == width).all():
        out = flat.reshape(-1, width)
    else:
        out = np.zeros((len(lens), width))
        out[np.arange(width) < lens[:, None]] = flat
    return _unit(out)


def _block(table: pa.Table, least: float, kind: str) -> pa.Table:
    """Links, and smallest ids reached, of the vectors of one block."""
    role, ids = table.column("role").to_numpy(), table.column("vec_id").to_numpy()
    units = _unit(np.frombuffer(b"".join(table.column("raw").to_pylist()), kind).reshape(len(ids), -1))
    home = table.column("home").to_numpy() == table.column("cell").to_numpy()
    m, p = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    linked = units[p] @ units[m].T >= least
    linked &= ~home[p][:, None] | (ids[p][:, None] < ids[m][None])
    low_p, low_m, far = ids[p].copy(), ids[m].copy(), np.iinfo(np.int64).max
    while True:
        now_m = np.minimum(low_m, np.where(linked, low_p[:, None], far).min(0, initial=far))
        now_p = np.minimum(low_p, np.where(linked, now_m[None], far).min(1, initial=far))
        if (now_m == low_m).all() and (now_p == low_p).all():
            break
        low_m, low_p = now_m, now_p
    links = np.concatenate([linked.sum(0), linked.sum(1)])
    keep = links > 0
    return pa.table({"vec_id": np.concatenate([ids[m], ids[p]])[keep], "links": links[keep].astype(np.int64), "low": np.concatenate([low_m, low_p])[keep]})


def near_duplicates(vectors: DataFrame, least: float = 0.93, recall: float = 0.9995, sample: int = 4096, per_cell: int = 64) -> DataFrame:
    """Links and components of ``vectors`` (vec_id, label, embedding).

    Vectors link when their labels and lengths are equal and their cosine is
    ``least`` at least.  Null labels and vectors that are null, empty, zero or
    hold null or non-finite components link with nothing.  Rows that repeat a
    vec_id are one vector, given by the smallest embedding.  Other columns play
    no part; an empty table gives none.  Codebooks have as many words as give
    ``per_cell`` vectors of a label to a cell and are fitted on about ``sample``
    vectors, or 8 a word where that is more.

    Returns vec_id, n_links, component_id and kept, one row per vec_id.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    usable = vectors.filter(F.col("label").isNotNull() & finite(v) & F.exists(v, lambda x: x != 0))
    usable = usable.groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("x")).select("vec_id", "x.label", "x.embedding")
    usable = materialize(usable.filter("vec_id is not null"), "dup-vectors")
    facts = usable.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels"), F.max(F.size("embedding")).alias("width")).first()
    ids = vectors.select("vec_id").distinct()
    if not facts["n"]:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = facts["width"]
    words = int(max(2, 2 ** round(np.log2(max(1, facts["n"] / facts["labels"] / per_cell)) / 2)))
    sample = max(sample, 8 * words)
    drawn = hash_sample(usable, "vec_id", facts["n"], sample).select("embedding").toArrow().column(0).combine_chunks()
    if not len(drawn):
        drawn = usable.limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    exact = "<f4" if usable.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    index = fit(_units(drawn, width), words, least, recall)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                units = _units(part.column("embedding"), width)
                a, b = index.distances(units)
                home = a.argmin(1) * len(index.right) + b.argmin(1)
                # cells above the own one only, so that one side of a pair looks for the other
                probes = [[int(h), *(c for c in index.nearest(x, y, index.visits) if c > h)] for h, x, y in zip(home.tolist(), a, b)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id").cast(pa.int64()), part.column("label"), pa.array(np.diff(part.column("embedding").offsets.to_numpy()).astype(np.int32)), pa.array(home.astype(np.int32)), pa.array(probes, pa.list_(pa.int32())), pa.array([v.values.to_numpy(zero_copy_only=False).astype(exact).tobytes() for v in part.column("embedding")], pa.binary())], names=["vec_id", "label", "width", "home", "probes", "raw"])

    kind = usable.schema["label"].dataType.simpleString()
    placed = materialize(usable.mapInArrow(assign, f"vec_id long, label {kind}, width int, home int, probes array<int>, raw binary"), "dup-placed")
    key = ["label", "width", "cell"]
    looks = placed.select("vec_id", "label", "width", "home", F.explode("probes").alias("cell"))
    size = placed.groupBy("label", "width", F.col("home").alias("cell")).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("m"))
    asked = looks.groupBy(*key).agg(F.ceil(F.count("*") / PROBES).cast("int").alias("p"))
    cells = materialize(size.join(asked, key), "dup-cells")
    cells = small(cells, cells)

    def dealt(rows: DataFrame, role: int, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id", F.lit(role)), F.col(own)).cast("int").alias(own)
        return rows.join(cells, key).select(*key, "vec_id", "home", "raw", F.lit(role).alias("role"), mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)).select(*key, "m", "p", "role", "vec_id", "home", "raw")

    members = placed.withColumn("cell", F.col("home"))
    probes = placed.select("vec_id", "label", "width", "home", "raw", F.explode("probes").alias("cell"))
    both = dealt(members, 0, "m", "p").unionAll(dealt(probes, 1, "p", "m"))
    found = both.groupBy(*key, "m", "p").applyInArrow(lambda t: _block(t, least, exact), "vec_id long, links long, low long")
    found = materialize(found, "dup-found")
    groups = connected_components(found.select("vec_id", "low"))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    out = ids.join(links, "vec_id", "left").join(groups.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
