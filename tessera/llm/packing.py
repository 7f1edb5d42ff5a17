"""Packing token queues of sources into windows at target proportions.

Each source is a queue of its documents' ids.  Deficit round-robin serves the
queues once per slice; a source of share p earns p slices' worth of ids, whole
ids are served and the fraction stays as its deficit.  After w slices a queue of
T ids has so served floor(T * w / slices) ids, whatever the partition, so each
document knows its cuts from its place in its queue, and deficits carry over
windows and partitions without passing state.  Under other targets than the
queues' own shares this holds from one end of a queue to the next: a phase ends
when a queue does, and those that are left share its part.  Slices follow one
another without a gap and are cut into windows of equal length; the last ids fill
windows whose lengths are powers of two, so that nothing is padded.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.llm.arrow import binaries, slices, small_batches
from tessera.llm.small import small
from tessera.llm.tokenizer import encoder
from tessera.runtime import materialize

WINDOW = 4096
#: Queues that sources share which earn less than one id a window.
SHARED = 1024
TOKENS = "doc_id long, source string, part long, local_start long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokens(docs: DataFrame, tokenizer: str, slots: int) -> DataFrame:
    """Ids of ``docs`` (doc_id, source, text) with the end id, and their places.

    ``part`` is the partition, ``local_start`` the ids of the source before the
    document in it.  The table is written once; a partition that is computed
    anew gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer, slots), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                piece = batch.slice(a, b - a)
                flat, lens = enc.encode_with_end(piece.column("text"))
                starts = []
                for q, n in zip(piece.column("source").to_pylist(), lens.tolist()):
                    starts.append(seen[q])
                    seen[q] += n
                cols = [piece.column("doc_id"), piece.column("source"), pa.array(np.full(len(lens), part)), pa.array(starts, pa.int64()), pa.array(lens), binaries(flat.astype("<u4"), lens)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "source", "part", "local_start", "n", "ids"])

    return materialize(docs.select("doc_id", "source", "text").mapInArrow(run, TOKENS), "pack-tokens")


class Phase:
    """Slices in which every queue is served in proportion to its ids here.

    ``low`` holds the places at which the phase begins in each queue, ``totals``
    the ids it serves of each, ``begin`` its first place in the whole.
    """

    def __init__(self, low: list[int], totals: list[int], begin: int, window: int):
        self.low, self.totals, self.begin = np.array(low, np.int64), totals, begin
        self.slices = max(1, -(-sum(totals) // window))
        kind = np.int64 if self.slices < 2**31 else object
        self.whole = np.array([t // self.slices for t in totals], kind)
        self.part = np.array([t % self.slices for t in totals], kind)

    def served(self, w: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """Ids that the queues have served after so many slices."""
        return self.whole[queue] * w + self.part[queue] * w // self.slices

    def slice_of(self, queue: int, at: int) -> int:
        """The slice that serves a place of a queue."""
        return ((at + 1) * self.slices - 1) // self.totals[queue]

    def base(self, w: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """Place in the phase of what a queue has in a slice."""
        known, back = np.unique(w, return_inverse=True)
        out = np.zeros(len(w), np.int64)
        for at in range(0, len(known), 256):
            some = known[at : at + 256]
            now = self.whole[None] * some[:, None] + self.part[None] * some[:, None] // self.slices
            then = self.whole[None] * (some[:, None] + 1) + self.part[None] * (some[:, None] + 1) // self.slices
            ahead = np.cumsum(then - now, axis=1) - (then - now) + now.sum(axis=1)[:, None]
            mine = np.flatnonzero((back >= at) & (back < at + 256))
            out[mine] = ahead[back[mine] - at, queue[mine]]
        return out

    def runs(self, row: np.ndarray, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, place in the queue, place in the whole and length of each run of ids."""
        # what lies in this phase, as places from its beginning
        a, b = np.maximum(start - self.low[queue], 0), np.minimum(start + n - self.low[queue], np.array(self.totals, np.int64)[queue])
        some = np.flatnonzero(b > a)
        row, queue, a, b = row[some], queue[some], a[some], b[some]
        first = np.array([self.slice_of(q, s) for q, s in zip(queue.tolist(), a.tolist())], np.int64)
        last = np.array([self.slice_of(q, e - 1) for q, e in zip(queue.tolist(), b.tolist())], np.int64)
        count = last - first + 1
        of = np.repeat(np.arange(len(row)), count)
        w = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        begins = self.served(w, queue[of])
        low, high = np.maximum(begins, a[of]), np.minimum(self.served(w + 1, queue[of]), b[of])
        keep = high > low
        of, w, begins, low, high = (x[keep] for x in (of, w, begins, low, high))
        at = self.begin + self.base(w, queue[of]) + (low - begins)
        return row[of], (self.low[queue[of]] + low).astype(np.int64), at.astype(np.int64), (high - low).astype(np.int64)


class Schedule:
    """Where each place of each queue comes to lie.

    ``totals`` are the ids of the queues, ``weights`` their target parts of every
    window, by default in proportion to the totals.  A queue of weight 0 is
    served after all others.
    """

    def __init__(self, totals: list[int], window: int = WINDOW, weights: list[float] | None = None):
        self.window, self.total = window, sum(totals)
        self.phases: list[Phase] = []
        low, begin = [0] * len(totals), 0
        for high in self._ends(totals, weights):
            part = [b - a for a, b in zip(low, high)]
            if sum(part):
                self.phases.append(Phase(low, part, begin, window))
                low, begin = high, begin + sum(part)
        self.full = self.total // window
        ends, at = [], self.full * window
        for bit in reversed(range((self.total % window).bit_length())):
            if self.total % window >> bit & 1:
                ends.append(at := at + (1 << bit))
        self.tail = np.array([self.full * window, *ends], np.int64)

    @staticmethod
    def _ends(totals: list[int], weights: list[float] | None) -> list[list[int]]:
        """Places of all queues at the end of each phase; the last are the totals."""
        if weights is None:
            return [totals]
        # a queue of T ids and weight w ends at time T / w, as exact fractions
        parts = [Fraction(w) for w in weights]
        times = sorted({t / p for t, p in zip(totals, parts) if p > 0 and t})
        ends = [[min(t, int(p * at)) if p > 0 and p * at < t else t if p > 0 else 0 for t, p in zip(totals, parts)] for at in times]
        return [*ends, totals]

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, offset in it, and ids from there to its end."""
        seq, off = at // self.window, at % self.window
        room = self.window - off
        if len(late := np.flatnonzero(at >= self.tail[0])):
            i = np.searchsorted(self.tail, at[late], side="right") - 1
            seq[late], off[late] = self.full + i, at[late] - self.tail[i]
            room[late] = self.tail[i + 1] - at[late]
        return seq, off, room

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, start in the document, length, window and offset of each piece."""
        found = [p.runs(np.arange(len(n)), queue, start, n) for p in self.phases]
        row, s, at, left = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
        rel = s - start[row]
        done = []
        while len(row):
            seq, off, room = self.place(at)
            size = np.minimum(left, room)
            done.append((row, rel, size, seq, off))
            more = left > size
            row, at, rel, left = row[more], (at + size)[more], (rel + size)[more], (left - size)[more]
        joined = [np.concatenate([d[i] for d in done]) if done else np.zeros(0, np.int64) for i in range(5)]
        order = np.lexsort((joined[1], joined[0]))
        return tuple(x[order] for x in joined)


def queues(totals: DataFrame, window: int, weights: dict[str, float] | None) -> DataFrame:
    """(source, queue) of ``totals`` (source, n).

    A source that earns an id of every window has a queue of its own; there are
    ``window`` such sources at most.  Each of the others earns less than one id a
    window, and they share ``SHARED`` queues by hash.  Under ``weights``, the
    sources they name have queues of their own as well.
    """
    whole = totals.agg(F.sum("n")).first()[0] or 0
    own = F.col("n") * window >= whole
    if weights:
        own |= F.col("source").isin([f"s{k}" for k in weights if k is not None])
        own |= F.lit(None in weights) & (F.col("source") == "n")
    shared = F.concat(F.lit("h"), F.pmod(F.xxhash64("source"), F.lit(SHARED)).cast("string"))
    return totals.select("source", F.when(own, F.col("source")).otherwise(shared).alias("queue"))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, slots: int = 1 << 21, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Pack ``docs`` (doc_id, text, source) into windows; one row per piece.

    ``weights`` are target parts of every window by source, 0 for sources that
    they don't name; by default each source's part is its share of all ids.  When
    a queue ends, those left keep their proportions.  A null text is empty and
    has the end id alone; a null source is a queue of its own; a null doc_id stays
    null.  Rows that repeat an id are documents of their own.  Other columns play
    no part; an empty table gives none.  ``slots`` bounds the word table of a
    worker and trades memory for time.
    """
    small_batches(docs.sparkSession)
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    made = tokens(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), "text"), tokenizer, slots)
    parts = materialize(made.groupBy("source", "part").agg(F.sum("n").alias("n")), "pack-totals")
    named = materialize(queues(parts.groupBy("source").agg(F.sum("n").alias("n")), window, weights), "pack-queues")
    # within a queue, partitions follow one another, and the sources of one partition
    before = F.coalesce(F.sum("n").over(W.partitionBy("queue").orderBy("part", "source").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(parts.join(small(named, named), "source").select("source", "queue", "part", "n", before.alias("base")), "pack-parts")
    totals = sorted((r["queue"], r["t"]) for r in parts.groupBy("queue").agg(F.sum("n").alias("t")).collect())
    given = None if weights is None else {"n" if k is None else f"s{k}": w for k, w in weights.items()}
    schedule = Schedule([t for _, t in totals], window, None if given is None else [given.get(q, 0) for q, _ in totals])
    index = {q: i for i, (q, _) in enumerate(totals)}
    placed = made.join(small(parts.select("source", "queue", "part", "base"), parts), ["source", "part"]).select("doc_id", "queue", (F.col("base") + F.col("local_start")).alias("start"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("ids")):
                part = batch.slice(a, b - a)
                n = part.column("n").to_numpy()
                queues = np.array([index[q] for q in part.column("queue").to_pylist()], np.int64)
                row, rel, size, seq, off = schedule.pieces(queues, part.column("start").to_numpy(), n)
                ids = [memoryview(x.as_buffer()) for x in part.column("ids")]
                crc = [zlib.crc32(ids[i][4 * s : 4 * (s + k)]) for i, s, k in zip(row.tolist(), rel.tolist(), size.tolist())]
                cols = [part.column("doc_id").take(pa.array(row)), pa.array(rel), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array(off)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, PIECES)
