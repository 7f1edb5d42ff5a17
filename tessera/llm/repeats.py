"""Removing bytes of long strings that occur earlier in the corpus.

Anchors (see suffixes.py) are sorted by Spark, which spills what memory doesn't
hold: its sorted shuffles are the external queues from which tuples come back in
order.  Anchors whose prefix occurs once drop out; of those with equal windows all
but the first are repeated as they stand; the few first ones whose prefix others
share, too, send their text, are sorted by it, and the windows before each anchor
are induced byte by byte with their common prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.arrow import slices, small_batches
from tessera.llm.small import small
from tessera.llm.suffixes import COVERED, LENGTH, RUN_MOST, induced, merged, packed, samples, unpacked, windows
from tessera.runtime import materialize, scratch

#: Anchors whose equal ones a task puts together before it sends them.
HELD = 1 << 19
#: Anchors that a task sorts at a time, in whole groups of one prefix.
MOST = 1 << 15
#: Anchors of one prefix beyond which their windows go one by one, to as many tasks as there are.
HOT = 1000
ROW = "key long, ctx long, doc long, sub long, at long"
_NAMES = ["key", "ctx", "doc", "sub", "at"]


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def _covered(doc: np.ndarray, sub: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of windows that are repeated, runs in one; any key will do."""
    _, code = np.unique(np.stack([doc, sub]), axis=1, return_inverse=True)
    one, lo, n = merged(lo, n, code.ravel())
    parts = -(-n // RUN_MOST)
    k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    one, lo, n = np.repeat(one, parts), np.repeat(lo, parts) + k * RUN_MOST, np.minimum(np.repeat(n, parts) - k * RUN_MOST, RUN_MOST)
    key = (doc[one] ^ lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return _batch(key.view(np.int64), np.zeros(len(one), np.int64), doc[one], sub[one], packed(lo, n, COVERED))


def _gathered(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Of anchors with equal windows the first, and the others as repeated."""
    key, ctx, doc, sub, at = columns
    hot = (key ^ (ctx * 3)).view(np.uint64)
    order = np.argsort(hot, kind="stable")
    same = hot[order][1:] == hot[order][:-1]
    alone = np.ones(len(order), bool)
    alone[1:] &= ~same
    alone[:-1] &= ~same
    many = order[~alone]
    many = many[np.lexsort((at[many], sub[many], doc[many], ctx[many], key[many]))]
    equal = np.zeros(len(many), bool)
    equal[1:] = (key[many][1:] == key[many][:-1]) & (ctx[many][1:] == ctx[many][:-1])
    twin = np.zeros(len(many), bool)
    twin[1:] = equal[1:] & (doc[many][1:] == doc[many][:-1]) & (sub[many][1:] == sub[many][:-1]) & (at[many][1:] == at[many][:-1])
    send = np.concatenate([order[alone], many[~equal]])
    yield _batch(*(c[send] for c in columns))
    if len(rest := many[equal & ~twin]):
        lo, n, _ = unpacked(at[rest])
        yield _covered(doc[rest], sub[rest], lo, n)


class _Held:
    """Rows of a task until there are enough to gather."""

    def __init__(self) -> None:
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.rows.append(columns)
        self.n += len(columns[0])
        if self.n >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield from _gathered([np.concatenate(x) for x in zip(*self.rows)])
        self.rows, self.n = [], 0


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Held()
    for batch in batches:
        for a, b in slices(batch.column("text")):
            rows = batch.slice(a, b - a)
            text, key, ctx, at = samples(rows.column("text").cast(pa.binary()).to_pylist())
            yield from held.add(key, ctx, _numpy(rows, "doc")[text], _numpy(rows, "sub")[text], at)
    yield from held.flush()


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of key, ctx and place the repeated ones, and the firsts that share their key."""
    last: np.ndarray | None = None  # the last anchor, by column
    head: np.ndarray | None = None  # the first anchor of the last class, while no other class of its key was seen

    for batch in batches:
        rows = np.stack([_numpy(batch, c) for c in _NAMES])
        done = (rows[4] & COVERED) == COVERED
        out = [rows[:, done]]
        rows = rows[:, ~done]
        if rows.shape[1]:
            # the row before the batch comes along as its first
            lead = last is not None
            ext = np.concatenate([last[:, None], rows], axis=1) if lead else rows
            equal = np.zeros(ext.shape[1], bool)
            equal[1:] = (ext[:2, 1:] == ext[:2, :-1]).all(axis=0)
            twin = np.zeros(ext.shape[1], bool)
            twin[1:] = equal[1:] & (ext[2:, 1:] == ext[2:, :-1]).all(axis=0)
            again = ext[:, equal & ~twin]
            lo, n, _ = unpacked(again[4])
            again[4] = packed(lo, n, COVERED)
            out.append(again)
            fresh = np.flatnonzero(~equal)
            fresh = fresh[fresh >= int(lead)]
            firsts = ext[:, fresh]
            if len(fresh):
                before = np.zeros(len(fresh), bool)  # another class of the key stands before
                before[1:] = firsts[0, 1:] == firsts[0, :-1]
                before[0] = lead and last[0] == firsts[0, 0]
                after = np.zeros(len(fresh), bool)
                after[:-1] = firsts[0, 1:] == firsts[0, :-1]
                if head is not None and before[0]:
                    out.append(head[:, None])
                out.append(firsts[:, before | after])
                head = None if before[-1] else firsts[:, -1].copy()
            last = rows[:, -1].copy()
        found = np.concatenate(out, axis=1)
        if found.shape[1]:
            yield _batch(*found)


def _resolved(rows: DataFrame) -> DataFrame:
    dealt = rows.repartition("key").sortWithinPartitions("key", "ctx", "doc", "sub", "at")
    return dealt.mapInArrow(_resolve, ROW)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text around the open anchors of each document, or the single windows of those with hot keys."""
    held = _Held()
    for batch in batches:
        for a, b in slices(batch.column("text"), most_rows=500):
            rows = batch.slice(a, b - a)
            doc, sub = rows.column("doc").to_pylist(), rows.column("sub").to_pylist()
            out: list[tuple] = []
            for i, (text, opened) in enumerate(zip(rows.column("text").cast(pa.binary()).to_pylist(), rows.column("opened").to_pylist())):
                lo, n, off = unpacked(np.array([x["at"] for x in opened], np.int64))
                for x, p, k, o in zip(opened, lo.tolist(), n.tolist(), off.tolist()):
                    if x["hot"]:
                        first, second = windows(text, p, k)
                        yield from map(_wide, held.add(first, second, np.full(k, doc[i]), np.full(k, sub[i]), packed(p + np.arange(k), np.ones(k), 0)))
                    else:
                        out.append((x["key"], doc[i], sub[i], x["at"], text[p : p + o], text[p + o : p + k - 1 + LENGTH]))
            if out:
                key, doc_, sub_, at, left, right = zip(*out)
                longs = [pa.array(c, pa.int64()) for c in (key, [0] * len(key), doc_, sub_, at)]
                yield pa.RecordBatch.from_arrays([*longs, pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=[*_NAMES, "left", "right"])
    yield from map(_wide, held.flush())


def _wide(batch: pa.RecordBatch) -> pa.RecordBatch:
    none = pa.nulls(batch.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([*batch.columns, none, none], names=[*_NAMES, "left", "right"])


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of key and right text; groups of whole keys at a time."""

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, doc, sub, at = (table.column(c).to_numpy() for c in ("key", "doc", "sub", "at"))
        group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        lo, _, off = unpacked(at)
        rank = np.empty(len(key), np.int64)
        by = np.lexsort((lo + off, sub, doc))
        rank[by] = np.concatenate([[0], np.cumsum(((np.diff(doc[by]) != 0) | (np.diff(sub[by]) != 0) | (np.diff((lo + off)[by]) != 0)))])
        row, start = induced(group, rank, at, table.column("left").to_pylist(), table.column("right").to_pylist())
        if len(row):
            yield _covered(doc[row], sub[row], start, np.ones(len(row), np.int64))

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= MOST:
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield from found(table.slice(0, cut))
                held, n = table.slice(cut).combine_chunks().to_batches(), len(key) - cut
    if n:
        yield from found(pa.Table.from_batches(held))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("text")):
            rows = batch.slice(a, b - a)
            sizes, gone, spans, digests = [], [], [], []
            for text, ats in zip(rows.column("text").cast(pa.binary()).to_pylist(), rows.column("ats")):
                text = text or b""
                kept, removed, runs, upto = hashlib.sha256(), 0, 0, 0
                if ats.is_valid and len(ats.values):
                    lo, n, _ = unpacked(np.sort(ats.values.to_numpy(zero_copy_only=False)))
                    ends = np.maximum.accumulate(lo + n - 1 + LENGTH)
                    first = np.flatnonzero(np.concatenate([[True], lo[1:] > ends[:-1]]))
                    last = np.append(first[1:] - 1, len(lo) - 1)
                    runs = len(first)
                    for x, y in zip(lo[first].tolist(), ends[last].tolist()):
                        kept.update(text[upto:x])
                        removed += y - x
                        upto = y
                kept.update(text[upto:])
                sizes.append(len(text))
                gone.append(removed)
                spans.append(runs)
                digests.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("doc"), rows.column("sub"), rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), pa.array(digests)], names=["doc", "sub", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _identified(docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, bool]:
    """doc_id and text with the order (doc, sub) of a text; whether ids repeat."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select("doc_id", "text", doc.alias("doc"))
    twice = keep(docs.groupBy("doc").agg(F.count("*").alias("k")).filter("k > 1").select("doc", F.lit(True).alias("twice")), "repeats-ids")
    if not twice.limit(1).count():
        return docs.withColumn("sub", F.lit(0).cast("long")), False
    sub = F.when(F.col("twice"), F.xxhash64(F.col("doc_id").isNotNull(), "text")).otherwise(F.lit(0).cast("long"))
    return docs.join(small(twice), "doc", "left").withColumn("sub", sub).drop("twice"), True


def remove_repeats(docs: DataFrame) -> DataFrame:
    """What is left of each text of ``docs`` (doc_id, text) without the bytes of earlier strings.

    Null and empty texts have no bytes.  Null ids come first; different texts
    that share an id come in the order of a hash, and of equal rows one is first
    and the others repeat it.  Other columns play no part; an empty table gives
    none.  Returns doc_id, n_bytes, n_removed, n_spans and kept_sha256.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with scratch(spark) as keep:
        docs, twice = _identified(docs, keep)
        texts = docs.filter(F.octet_length("text") >= LENGTH).select("doc", "sub", "text")
        rows = keep(_resolved(texts.mapInArrow(_sample, ROW)), "repeats-anchors")
        repeated = F.col("at").bitwiseAND(COVERED) == COVERED
        opened, covered = rows.filter(~repeated), rows.filter(repeated).select("doc", "sub", "at")
        hot = keep(opened.groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") > HOT).select("key", F.lit(True).alias("hot")), "repeats-hot")
        any_hot = hot.limit(1).count() > 0
        opened = opened.join(small(hot), "key", "left") if any_hot else opened.withColumn("hot", F.lit(None).cast("boolean"))
        lists = opened.groupBy("doc", "sub").agg(F.collect_list(F.struct("key", "at", "hot")).alias("opened"))
        around = keep(texts.join(lists, ["doc", "sub"]).mapInArrow(_contexts, f"{ROW}, left binary, right binary"), "repeats-contexts")
        tuples = around.filter("right is not null").repartition("key").sortWithinPartitions("key", "right")
        covered = covered.unionAll(tuples.mapInArrow(_induce, ROW).select("doc", "sub", "at"))
        if any_hot:
            single = _resolved(around.filter("right is null").select(*_NAMES))
            covered = covered.unionAll(single.filter(repeated).select("doc", "sub", "at"))
        ats = covered.groupBy("doc", "sub").agg(F.collect_list("at").alias("ats"))
        kind = dict(docs.dtypes)["doc_id"]
        out = docs.join(ats, ["doc", "sub"], "left").mapInArrow(_finish, f"doc long, sub long, doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        if twice:  # of equal rows, all but one repeat what is there whole
            out = keep(out, "repeats-rows").withColumn("copy", F.expr("row_number() over (partition by doc, sub order by n_bytes) > 1 and n_bytes >= " + str(LENGTH)))
            out = out.withColumn("n_removed", F.expr("if(copy, n_bytes, n_removed)")).withColumn("n_spans", F.expr("if(copy, 1, n_spans)")).withColumn("kept_sha256", F.expr("if(copy, sha2('', 256), kept_sha256)"))
        return materialize(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), "repeats")
