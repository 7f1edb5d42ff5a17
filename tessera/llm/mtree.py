"""Exact top-k by inner product with paged M-trees.

Vectors get one more coordinate that brings all of a tree to one length; larger
inner products are then smaller distances.  A tree is built in bulk over one
shard and kept as pages: routing objects with covering radii and distances to
their parents, and leaves with the distances of their entries.  A search visits
pages best first and uses the stored distances and the triangle inequality to
skip pages and entries without computing their distances.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.llm.small import small
from tessera.llm.vectors import finite, hash_sample
from tessera.runtime import materialize

#: Entries of a leaf, and children of a routing page.
PAGE, FANOUT = 512, 8
#: Vectors of a shard, queries of a block, and groups in which queries meet roots.
SHARD, BLOCK, ROOTS = 8192, 1024, 8
FOUND = "query_id long, vec_id long, score long"
SENT = "width int, cell int, cut int, block int, vec_id long, v array<long>, least long"
PAGES = "width int, cell int, cut int, page int, parent int, center binary, radius double, parent_dist double, top double, ids binary, entries binary, entry_dist binary"


def _lifted(rows: np.ndarray, top: float) -> np.ndarray:
    norm = (rows.astype(np.float64) ** 2).sum(1)
    return np.concatenate([rows.astype(np.float64), np.sqrt(np.maximum(top - norm, 0))[:, None]], axis=1)


def build(ids: np.ndarray, rows: np.ndarray, shard: int, seed: int = 5, leaf: int = PAGE) -> list[dict]:
    """The pages of one tree; page 0 is the root."""
    rng = np.random.default_rng(seed)
    top = float((rows.astype(np.float64) ** 2).sum(1).max())
    points = _lifted(rows, top)
    pages: list[dict] = []
    work = [(np.arange(len(ids)), -1)]
    while work:
        mine, parent = work.pop()
        center = points[mine].mean(0)
        far = np.linalg.norm(points[mine] - center, axis=1)
        up = 0.0 if parent < 0 else float(np.linalg.norm(center - np.frombuffer(pages[parent]["center"])))
        page = {"shard": shard, "page": len(pages), "parent": parent, "center": center.tobytes(), "radius": float(far.max()), "parent_dist": up, "top": top, "ids": None, "entries": None, "entry_dist": None}
        pages.append(page)
        # equal points can't be told apart, so they are cut by number
        if len(mine) <= leaf:
            page |= {"ids": ids[mine].astype("<i8").tobytes(), "entries": rows[mine].astype("<i8").tobytes(), "entry_dist": far.tobytes()}
        elif far.max() == 0 or len(spread := np.unique(points[mine], axis=0)) <= 1:
            work += [(mine[at : at + max(leaf, -(-len(mine) // FANOUT))], page["page"]) for at in range(0, len(mine), max(leaf, -(-len(mine) // FANOUT)))]
        else:
            pivots = spread[rng.choice(len(spread), min(FANOUT, len(spread)), replace=False)]
            near = ((pivots**2).sum(1) - 2 * points[mine] @ pivots.T).argmin(1)
            groups = [mine[near == i] for i in range(len(pivots))]
            groups = [g for g in groups if len(g)]
            if len(groups) == 1:
                groups = [mine[: len(mine) // 2], mine[len(mine) // 2 :]]
            work += [(g, page["page"]) for g in groups]
    return pages


class MTree:
    """The pages of one shard, ready to be searched."""

    def __init__(self, pages: list[dict]):
        pages = sorted(pages, key=lambda p: p["page"])
        self.top = pages[0]["top"]
        self.centers = np.stack([np.frombuffer(p["center"]) for p in pages])
        self.radius = np.array([p["radius"] for p in pages])
        self.parent_dist = np.array([p["parent_dist"] for p in pages])
        self.children: list[list[int]] = [[] for _ in pages]
        for p in pages[1:]:
            self.children[p["parent"]].append(p["page"])
        self.children = [np.array(c, np.int64) for c in self.children]
        width = self.centers.shape[1] - 1
        whole = {p["page"]: np.frombuffer(p["entries"], "<i8").reshape(-1, width) for p in pages if p["ids"] is not None}
        self.most = max(max(abs(int(w.max())), abs(int(w.min()))) for w in whole.values())
        # sums below 2**53 are exact in double precision, which is faster than integers
        self.leaves = {p["page"]: (np.frombuffer(p["ids"], "<i8"), whole[p["page"]], whole[p["page"]].astype(np.float64), np.frombuffer(p["entry_dist"])) for p in pages if p["ids"] is not None}
        self.computed = 0

    def search(self, ident: int, query: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The ``k`` best (score, id), equal scores by smaller id, without ``ident``.

        Those below ``least`` needn't be found.
        """
        q = np.concatenate([query.astype(np.float64), [0.0]])
        norm = float(query.astype(np.float64) @ query.astype(np.float64))
        slack = 1e-9 * (norm + self.top) + 0.5
        size = max(1, self.most) * max(1, max(abs(int(query.max())), abs(int(query.min())))) * len(query)
        exact, large = size < 2**53, size >= 2**63
        best: list[tuple[int, int]] = []  # a heap with the worst first: (score, -id)
        limit = start = np.inf if least is None else np.sqrt(max(0.0, norm + self.top - 2 * least) + slack)

        def distance(pages: np.ndarray) -> np.ndarray:
            self.computed += len(pages)
            return np.linalg.norm(self.centers[pages] - q, axis=1)

        root = float(distance(np.array([0]))[0])
        heap = [(max(0.0, root - self.radius[0]), 0, root)]
        while heap:
            bound, page, away = heapq.heappop(heap)
            if bound > limit:
                break
            if page in self.leaves:
                ids, entries, floats, far = self.leaves[page]
                near = np.flatnonzero((np.abs(away - far) <= limit) & (ids != ident))
                self.computed += len(near)
                if large:  # Python's integers have no end
                    score = entries[near].astype(object) @ query.astype(object)
                else:
                    score = (floats[near] @ q[:-1]).astype(np.int64) if exact else entries[near] @ query
                if len(near) > k:  # ties with the last of the page's best stay in
                    keep = score >= np.sort(score)[-k]
                    near, score = near[keep], score[keep]
                for s, i in zip(score.tolist(), ids[near].tolist()):
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    limit = min(start, np.sqrt(max(0.0, norm + self.top - 2 * best[0][0]) + slack))
            else:
                below = self.children[page]
                below = below[np.abs(away - self.parent_dist[below]) - self.radius[below] <= limit]
                d = distance(below)
                for b, p, x in zip(np.maximum(0.0, d - self.radius[below]).tolist(), below.tolist(), d.tolist()):
                    if b <= limit:
                        heapq.heappush(heap, (b, p, x))
        if any(not -(2**63) <= s < 2**63 for s, _ in best):
            raise OverflowError(f"a score of query {ident} is beyond a long")
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _unique(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer rows, the smallest row of an id that repeats."""
    ids = table.column("vec_id").to_numpy()
    rows = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    order = np.lexsort((*rows.T[::-1], ids))
    ids, rows = ids[order], rows[order]
    first = np.concatenate([[True], ids[1:] != ids[:-1]])
    return ids[first], rows[first]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """The ``k`` best of ``vectors`` for each of ``queries`` (vec_id, embedding).

    Components x become floor(``scale`` * x) in double precision; the score is
    the integer inner product, equal scores go to the smaller vec_id, and a
    query doesn't find its own vec_id.  Vectors are compared with those of their
    own length.  Those that are null, empty or hold null or non-finite
    components, and null ids, take no part.  Rows that repeat a vec_id are
    one vector, given by the smallest.  A component, or a score among the best,
    that a long can't hold is an error.

    Shards are the vectors nearest to the same of some drawn pivots, split by
    hash where that is more than a shard's worth.  Each query searches its
    nearest shard first; its ``k``-th best score there and the radii of the other
    shards decide which of those it goes to as well.

    Returns query_id, rank, vec_id and score.
    """
    spark = vectors.sparkSession
    scaled = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * F.lit(float(scale))) < float(2**63), F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).otherwise(F.raise_error(F.lit("a scaled component is beyond a long")).cast("long")))

    def clean(df: DataFrame) -> DataFrame:
        whole = df.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
        return whole.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))

    data, asked = materialize(clean(vectors), "mtree-vectors"), clean(queries)
    counts = {r["width"]: r["n"] for r in data.groupBy("width").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = {}
    for width, n in counts.items():
        if n > SHARD:
            some = hash_sample(data.filter(F.col("width") == width), "vec_id", n, 2 * -(-n // SHARD)).select("v").toArrow().column(0).combine_chunks()
            pivots[width] = np.unique(some.flatten().to_numpy().reshape(-1, width), axis=0).astype(np.float64)
    shared = spark.sparkContext.broadcast({w: p for w, p in pivots.items() if len(p)})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            widths = batch.column("width").to_numpy()
            for width, points in shared.value.items():
                mine = np.flatnonzero(widths == width)
                for at in range(0, len(mine), 1024):
                    some = mine[at : at + 1024]
                    rows = batch.column("v").take(pa.array(some)).flatten().to_numpy().reshape(-1, width).astype(np.float64)
                    cell[some] = ((points**2).sum(1) - 2 * rows @ points.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["vec_id", "v", "width", "cell"])

    placed = "vec_id long, v array<long>, width int, cell int"
    data = materialize(data.mapInArrow(near, placed), "mtree-data")
    sizes = materialize(data.groupBy("width", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("cuts")), "mtree-sizes")
    key = ["width", "cell", "cut"]
    dealt = data.join(small(sizes, sizes), ["width", "cell"]).withColumn("cut", F.pmod(F.xxhash64("vec_id", F.lit("cut")), F.col("cuts")).cast("int"))

    def grow(table: pa.Table) -> pa.Table:
        ids, rows = _unique(table)
        pages = build(ids, rows, 0)
        kinds = [pa.int32()] * 3 + [pa.binary(), pa.float64(), pa.float64(), pa.float64()] + [pa.binary()] * 3
        cols = {name: pa.array([p[name] for p in pages], kind) for name, kind in zip(pages[0], kinds)}
        return pa.table({c: pa.array([table.column(c)[0].as_py()] * len(pages), pa.int32()) for c in key} | {n: v for n, v in cols.items() if n != "shard"})

    pages = materialize(dealt.groupBy(*key).applyInArrow(grow, PAGES), "mtree-pages")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            tree = MTree(left.to_pylist())
            least = dict(zip(right.column("vec_id").to_pylist(), right.column("least").to_pylist()))
            for ident, row in zip(*_unique(right)):
                for score, i in tree.search(int(ident), row, k, least[int(ident)]):
                    out["query_id"].append(int(ident))
                    out["vec_id"].append(i)
                    out["score"].append(score)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    def searched(sent: DataFrame, name: str) -> DataFrame:
        """Best of the shards that ``sent`` (key, block, vec_id, v, least) names."""
        sent = materialize(sent, f"mtree-{name}-sent")
        blocks = materialize(sent.select(*key, "block").distinct(), f"mtree-{name}-blocks")
        grid = pages.join(small(blocks, blocks), key)
        return materialize(grid.groupBy(*key, "block").cogroup(sent.groupBy(*key, "block")).applyInArrow(search, FOUND), f"mtree-{name}")

    asked = materialize(asked.mapInArrow(near, placed), "mtree-asked")
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(max(1, -(-asked.count() // BLOCK)))).cast("int").alias("block")
    roots = pages.filter("page = 0").select(*key, "center", "radius", "top")
    home = asked.join(roots.select(*key), ["width", "cell"])
    first = searched(home.select(*key, block, "vec_id", "v", F.lit(None).cast("long").alias("least")), "home")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    known = first.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
    going = asked.withColumnRenamed("cell", "home").join(known, "vec_id", "left")

    def reach(left: pa.Table, right: pa.Table) -> pa.Table:
        """Shards of ``right`` that may hold better ones than queries of ``left`` have."""
        out = {c: [] for c in ("cell", "cut", "at")}
        if left.num_rows and right.num_rows:
            rows = left.column("v").combine_chunks().flatten().to_numpy().reshape(left.num_rows, -1).astype(np.float64)
            least = left.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            home = left.column("home").to_numpy()
            norm = (rows**2).sum(1)
            for r in right.select(["cell", "cut", "center", "radius", "top"]).to_pylist():
                center = np.frombuffer(r["center"])
                away = np.sqrt(((rows - center[:-1]) ** 2).sum(1) + center[-1] ** 2)
                limit = norm + r["top"] - 2 * least + 1e-9 * (norm + r["top"]) + 0.5
                some = np.flatnonzero((home != r["cell"]) & ~(np.maximum(0, away - r["radius"]) ** 2 > limit))
                out["cell"] += [r["cell"]] * len(some)
                out["cut"] += [r["cut"]] * len(some)
                out["at"] += some.tolist()
        at = pa.array(out["at"], pa.int64())
        cells = [pa.array(out[c], pa.int32()) for c in ("cell", "cut")]
        taken = left.select(["width", "block", "vec_id", "v", "least"]).take(at)
        return pa.table({"width": taken.column("width"), "cell": cells[0], "cut": cells[1], "block": taken.column("block"), "vec_id": taken.column("vec_id"), "v": taken.column("v"), "least": taken.column("least")})

    # a block of queries meets the roots in groups, a page each
    group = F.pmod(F.xxhash64("cell", "cut"), F.lit(ROOTS)).cast("int").alias("root_group")
    waiting = materialize(going.withColumn("block", block), "mtree-going").withColumn("root_group", F.explode(F.sequence(F.lit(0), F.lit(ROOTS - 1))))
    offered = materialize(waiting.select("width", "block").distinct(), "mtree-waiting")
    met = roots.withColumn("root_group", group).join(small(offered, offered), "width")
    rest = waiting.groupBy("width", "block", "root_group").cogroup(met.groupBy("width", "block", "root_group")).applyInArrow(reach, SENT)
    second = searched(rest, "rest")
    best = first.unionAll(second).withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
