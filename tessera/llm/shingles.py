"""Sets of word shingles as 64-bit hashes, and fixed-size summaries of all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessera.llm.arrow import claim, slices

#: Odd multipliers of the words of a shingle, and of the mixer.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
MAX_WORDS = 150_000
#: Blocks of a summary, and groups of partitions that are folded first.
BLOCKS, GROUPS = 64, 16
_WORDS: dict[bytes, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX[0]
    h = (h ^ (h >> np.uint64(33))) * MIX[1]
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``n``-word shingles of each text.

    A-Z are lower-cased and words are parted by ASCII white space.  Fewer words
    than ``n`` are one shingle; no word, or null, gives an empty set.
    """
    claim("shingles", _WORDS.clear)
    if len(_WORDS) > MAX_WORDS:
        _WORDS.clear()
    parts = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    get = _WORDS.get
    words = [w for p in parts for w in p]
    codes = [get(w) for w in words]
    for i, c in enumerate(codes):
        if c is None:
            w = words[i]
            if (c := get(w)) is None:
                c = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
            codes[i] = c
    flat = np.array(codes, np.uint64)
    out, at = [], 0
    for p in parts:
        h = flat[at : at + len(p)]
        at += len(p)
        if len(h) < n:
            out.append(_mixed(np.array([int((h * PLACES[: len(h)]).sum(dtype=np.uint64)) ^ len(h)], np.uint64)) if len(h) else h)
            continue
        total = h[: len(h) - n + 1] * PLACES[0]
        for i in range(1, n):
            total = total + h[i : len(h) - n + 1 + i] * PLACES[i]
        out.append(np.unique(_mixed(total)))
    return out


def folded(blobs: DataFrame, fold: Callable[[list[np.ndarray]], np.ndarray], kind: str) -> list[tuple[int, np.ndarray]]:
    """Fold blobs (block, part, data) of each block in two levels; the blocks in order.

    A summary has a fixed number of blocks of a fixed size, so what reaches the
    driver doesn't grow with the input.
    """

    def merge(table: pa.Table) -> pa.Table:
        d = zstandard.ZstdDecompressor()
        total = fold([np.frombuffer(d.decompress(x), kind) for x in table.column("data").to_pylist()])
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "data": pa.array([zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(total).astype(kind).tobytes())], pa.binary())})

    once = blobs.withColumn("part", F.pmod("part", F.lit(GROUPS))).groupBy("block", "part").applyInArrow(merge, "block int, data binary")
    rows = once.groupBy("block").applyInArrow(merge, "block int, data binary").collect()
    d = zstandard.ZstdDecompressor()
    return sorted(((r["block"], np.frombuffer(d.decompress(bytes(r["data"])), kind)) for r in rows), key=lambda x: x[0])


def blobs_of(part: int, values: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """The blocks of one partition's summary; those without a value are left out."""
    c = zstandard.ZstdCompressor(1)
    for block, some in enumerate(values.reshape(BLOCKS, -1)):
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([c.compress(some.astype(kind).tobytes())], pa.binary())], names=["block", "part", "data"])


def _filled(blocks: list[tuple[int, np.ndarray]], bits: int, kind: str) -> np.ndarray:
    out = np.zeros(1 << bits, kind)
    for block, values in blocks:
        out[block * len(values) : (block + 1) * len(values)] = values
    return out


def frequency_levels(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """For each of 2**bits slots, four times the log of its shingles' documents.

    Every shingle of every text of ``docs`` (text) is counted in the slot of its
    low bits; a slot counts all shingles that share it.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                found = np.concatenate(shingle_sets(batch.column("text").slice(a, b - a).to_pylist(), n))
                slot, times = np.unique(found & np.uint64((1 << bits) - 1), return_counts=True)
                seen[slot.astype(np.int64)] += times.astype(np.uint32)
        yield from blobs_of(TaskContext.get().partitionId(), seen, "<u4")

    blobs = docs.select("text").mapInArrow(count, "block int, part int, data binary")
    wide = lambda parts: np.minimum(np.sum(parts, axis=0, dtype=np.uint64), 0xFFFFFFFF)
    return np.minimum(255, 4 * np.log2(1.0 + _filled(folded(blobs, wide, "<u4"), bits, "<u4"))).astype(np.uint8)


def id_filter(ids: DataFrame, bits: int = 24) -> np.ndarray:
    """Slots that some id of the single long column of ``ids`` falls into.

    A fixed-size filter without false negatives; an exact join follows its use.
    """
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[id_slots(batch.column(0).to_numpy(zero_copy_only=False), bits)] = True
        yield from blobs_of(TaskContext.get().partitionId(), seen.view(np.uint8), "u1")

    blobs = ids.mapInArrow(mark, "block int, part int, data binary")
    return np.packbits(_filled(folded(blobs, lambda parts: np.max(parts, axis=0), "u1"), bits, "u1"))


def id_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def maybe_in(ids: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Whether ids may be among those of ``id_filter``."""
    slot = id_slots(ids, int(np.log2(len(packed) * 8)))
    return packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 == 1
