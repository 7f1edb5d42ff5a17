"""Exact Jaccard join of n-gram sets by rare-first prefix filtering.

Shingles have one order for all texts: rarer slots of a frequency summary first,
then the hash.  Two sets that are similar enough share a shingle among the first
few of both, so texts meet on those prefix shingles only.  Pairs that meet pass
the length, positional and suffix filters and are verified once each.  A prefix
shingle of many texts doesn't list its pairs: the texts that such shingles
connect form clusters, and a cluster is verified in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.arrow import slices, small_batches
from tessera.llm.shingles import frequency_levels, id_filter, maybe_in, shingle_sets
from tessera.llm.small import small
from tessera.operators.components import connected_components
from tessera.runtime import materialize

#: Texts of a prefix shingle, or of one of its bands, up to which their pairs are listed.
LISTED = 24
#: Texts and shingles of one side of a block.
BLOCK_TEXTS, BLOCK_SHINGLES = 128, 100_000
#: Cells of the histogram that the suffix filter compares.
CELLS = 16
COLUMNS = 8192


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles of a set of ``n`` among which a similar set must share one."""
    return n - -(-num * n // den) + 1


def overlap_needed(a: Column, b: Column, num: int, den: int) -> Column:
    """Common shingles from which sets of sizes ``a`` and ``b`` link."""
    return F.ceil((a + b) * num / (num + den) - 1e-9)


def describe(docs: DataFrame, n: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n, two digests of the set, prefix shingles in order, histogram."""
    mask = np.uint64(len(levels) - 1)
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column("text").to_pylist(), n)
                size = np.array([len(s) for s in sets], np.int64)
                keep = prefix_length(size, num, den) * (size > 0)
                first, cells, d1, d2 = [], [], [], []
                for s, k in zip(sets, keep.tolist()):
                    order = (table[(s & mask).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                    first.append(s[np.argsort(order, kind="stable")[:k]])
                    cells.append(np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=CELLS))
                    raw = s.tobytes()
                    d1.append(xxhash.xxh3_64_intdigest(raw))
                    d2.append(xxhash.xxh3_64_intdigest(raw, 1))
                flat = np.concatenate(first).view(np.int64) if first else np.zeros(0, np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)), pa.array(flat))
                signed = lambda d: pa.array(np.array(d, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), signed(d1), signed(d2), tokens, pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(cells)), CELLS).cast(pa.list_(pa.int64()))], names=["doc_id", "n", "d1", "d2", "tokens", "cells"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, tokens array<long>, cells array<long>")
    return materialize(out, "ngram-info")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(cid, items) of the documents whose ids ``wanted`` (cid) holds, and a few more."""
    some = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select("cid")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = some.value
        for batch in batches:
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            mine = batch.filter(pa.array(maybe_in(ids, packed)))
            for a, b in slices(mine.column("text")):
                part = mine.slice(a, b - a)
                sets = shingle_sets(part.column("text").to_pylist(), n)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["cid", "items"])

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "cid long, items array<long>")
    return materialize(found, "ngram-sets")


def _hits(lead: DataFrame, often: DataFrame) -> DataFrame:
    """Prefix shingles of ``lead`` that are in ``often``, with both sides' columns.

    Most prefix shingles are of one text only; a fixed-size filter drops their
    rows before anything is moved, and the join drops what it lets through.
    """
    some = lead.sparkSession.sparkContext.broadcast(id_filter(often.select("token"), 25))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = some.value
        for batch in batches:
            column = batch.column("tokens")
            count = np.diff(column.offsets.to_numpy())
            token = column.flatten().to_numpy()
            row = np.repeat(np.arange(len(count)), count)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
            keep = maybe_in(token, packed)
            row = row[keep]
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array(pos[keep].astype(np.int32)), pa.array(token[keep])], names=["cid", "n", "pos", "token"])

    entries = lead.select("cid", "n", "tokens").mapInArrow(run, "cid long, n long, pos int, token long")
    return materialize(entries.join(often, "token"), "ngram-hits")


def _verify_block(table: pa.Table, num: int, den: int) -> pa.Table:
    """Smallest ids that the texts of a block reach through links in it."""
    ids = table.column("cid").to_numpy()
    column = table.column("items").combine_chunks()
    size = np.diff(column.offsets.to_numpy()).astype(np.int64)
    _, code, times = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(ids)), size), times[code] > 1
    row, code = row[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    common = np.zeros((len(ids), len(ids)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [at, at + COLUMNS])
        some = np.zeros((len(ids), COLUMNS), np.float32)
        some[row[a:b], code[a:b] - at] = 1
        common += some @ some.T
    common = common.astype(np.int64)
    linked = common * den >= num * (size[:, None] + size[None] - common)
    np.fill_diagonal(linked, False)
    low, far = ids.copy(), np.iinfo(np.int64).max
    while True:
        now = np.minimum(low, np.where(linked, low[None], far).min(1, initial=far))
        if (now == low).all():
            break
        low = now
    keep = linked.any(1)
    return pa.table({"u": ids[keep], "v": low[keep]})


def _listed_pairs(buckets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that meet in a listed bucket (cid, n, pos, own, and columns that name it) and pass length and position."""
    by = [c for c in buckets.columns if c not in ("cid", "n", "pos", "own")]
    members = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("cid", "n", "pos", "own"))).alias("x"))

    def passes(p: Column, q: Column) -> Column:
        small, large = F.least(p["n"], q["n"]), F.greatest(p["n"], q["n"])
        most = F.least(p["n"] - p["pos"], q["n"] - q["pos"])
        return (p["cid"] < q["cid"]) & (p["own"] | q["own"]) & (small * den >= large * num) & (most >= overlap_needed(p["n"], q["n"], num, den))

    def later(p: Column, i: Column) -> Column:
        rest = F.filter(F.slice(F.col("x"), i + 2, LISTED), lambda q: passes(p, q))
        return F.transform(rest, lambda q: F.struct(p["cid"].alias("a"), q["cid"].alias("b")))

    return members.select(F.explode(F.flatten(F.transform("x", later))).alias("p")).select("p.a", "p.b").distinct()


def _banded(hits: DataFrame, num: int, den: int) -> DataFrame:
    """Texts of the shingles beyond the listed, by bands of size, with the texts, own texts and leader of each bucket.

    Sizes that can link lie in one band or in neighbouring ones, so a text goes to
    its own band and, as a guest, to the next.  Two guests meet in the band before.
    """
    width = float(np.log(den / num)) + 1e-6
    hot = hits.filter(F.col("m") > LISTED).select("token", "cid", "n", "pos", F.floor(F.log("n") / width).alias("_band"))
    rows = hot.select("token", "cid", "n", "pos", F.explode(F.array(F.struct(F.col("_band").alias("band"), F.lit(True).alias("own")), F.struct((F.col("_band") + 1).alias("band"), F.lit(False).alias("own")))).alias("x")).select("token", "cid", "n", "pos", "x.*")
    sums = rows.groupBy("token", "band").agg(F.count("*").alias("m"), F.count_if("own").alias("k"), F.min("cid").alias("leader")).filter("k > 0 and m > 1")
    return materialize(rows.join(sums, ["token", "band"]), "ngram-banded")


def _clusters(banded: DataFrame) -> DataFrame:
    """(cid, cluster) of the texts that buckets beyond the listed connect, each band on its own."""
    node = lambda c: F.xxhash64(c, "band")  # noqa: E731 (equal hashes put clusters together, which loses nothing)
    met = banded.filter(F.col("m") > LISTED).select("cid", node("cid").alias("u"), node("leader").alias("v"))
    found = connected_components(met.select("u", "v").distinct()).select(F.col("node").alias("u"), F.col("component").alias("cluster"))
    return materialize(met.select("cid", "u").distinct().join(found, "u").select("cid", "cluster").distinct(), "ngram-clusters")


def _block_links(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) within clusters; each pair of blocks is one group."""
    total = members.join(sets, "cid").groupBy("cluster").agg(F.count("*").alias("texts"), F.sum(F.size("items")).alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("texts") / BLOCK_TEXTS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = members.join(total.select("cluster", blocks.alias("blocks")), "cluster").join(sets, "cid")
    own = F.pmod(F.xxhash64("cid", F.lit("block")), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "cid", "items")
    return pairs.groupBy("cluster", "lo", "hi").applyInArrow(lambda t: _verify_block(t, num, den), "u long, v long")


def _repeated(info: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) from each doc_id that has several texts to their classes."""
    key = ["d1", "d2", "n"]
    one = F.struct(*key)
    several = info.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(one).alias("a"), F.max(one).alias("b")).filter("a <> b").select("doc_id")
    several = materialize(several, "ngram-several")
    rows = info.join(small(several, several), "doc_id").select("doc_id", *key).distinct()
    return rows.join(classes, key).select(F.col("doc_id").alias("u"), F.col("cid").alias("v"))


def ngram_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, bits: int = 22) -> DataFrame:
    """Size of the shingle set and component of each of ``docs`` (doc_id, text).

    Two texts link when the ``n``-word shingles that both have are ``num`` of
    ``den`` parts of those that either has, or more, exactly but for shingles of
    equal 64-bit hashes.  Texts of fewer words are one shingle; texts without
    words, empty or null, link with nothing and stand alone.  Equal sets are one
    class from the start and stay linked; no pair is left out, whatever the
    number of partners.  Rows that repeat a doc_id are one node: their texts'
    classes are linked, and each row is kept.  Rows without a doc_id link with
    nothing and have a null component.  Other columns play no part; an empty
    table gives none.  ``bits`` sets the slots of the frequency summary, which
    only orders shingles.  The suffix filter compares the sets' histograms over
    equal ranges of the hash, a bound that never drops a pair that links.

    Returns doc_id, n_shingles and component_id, the smallest doc_id reached.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    info = describe(docs, n, num, den, frequency_levels(docs, n, bits))
    key = ["d1", "d2", "n"]
    classes = materialize(info.filter("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("cid")), "ngram-classes")
    lead = materialize(info.join(classes, (info.doc_id == classes.cid) & (info.d1 == classes.d1) & (info.d2 == classes.d2)).select("cid", info.n, "tokens", "cells"), "ngram-lead")
    entries = lead.select("cid", F.explode("tokens").alias("token"))
    often = materialize(entries.groupBy("token").agg(F.count("*").alias("m"), F.min("cid").alias("leader")).filter("m > 1"), "ngram-often")
    hits = _hits(lead, often)
    sizes = lead.select("cid", "n", "cells")
    banded = _banded(hits, num, den)
    bucket = ["cid", "n", "pos", "own", "token"]
    listed = _listed_pairs(hits.filter(F.col("m") <= LISTED).withColumn("own", F.lit(True)).select(*bucket), num, den)
    pairs = listed.union(_listed_pairs(banded.filter(F.col("m") <= LISTED).select(*bucket, "band"), num, den)).distinct()
    both = pairs.join(sizes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca")), "a").join(sizes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb")), "b")
    # the suffix filter: sets that differ so much in some cells can't share enough
    apart = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    pairs = materialize(both.filter(apart <= F.col("na") + F.col("nb") - 2 * overlap_needed(F.col("na"), F.col("nb"), num, den)).select("a", "b"), "ngram-pairs")
    members = _clusters(banded)
    sets = _sets(docs, pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).union(members.select("cid")).distinct(), n)
    sided = lambda c: sets.select(F.col("cid").alias(c), F.col("items").alias(f"i{c}"))
    common = F.size(F.array_intersect("ia", "ib"))
    united = F.size("ia") + F.size("ib") - common
    links = pairs.join(sided("a"), "a").join(sided("b"), "b").filter(common * den >= united * num).select(F.col("a").alias("u"), F.col("b").alias("v"))
    links = links.union(_block_links(members, sets, num, den))
    groups = connected_components(materialize(links.union(_repeated(info, classes)), "ngram-links"))
    named = classes.join(groups.select(F.col("node").alias("cid"), "component"), "cid", "left").select(*key, F.coalesce("component", "cid").alias("component"))
    found = info.select("doc_id", *key).join(named, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
