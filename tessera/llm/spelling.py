"""Spelling variants: words one edit apart, and the form that each of them has.

A word whose edit lies in its second half shares its first half with the other
word; one whose edit lies in the first half shares the second, which is the first
of the reversed word.  So words are dealt by ranges twice, forward and reversed,
and a word asks the shards that its half reaches into.  In a shard each edit
position is a rectangle: the interval of the prefix before it in forward order by
the interval of the suffix behind it in reverse order, and a wavelet tree reports
the words in it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessera.llm.arrow import slices, small_batches
from tessera.llm.wavelet import WaveletTree
from tessera.runtime import materialize, scratch

#: A-Z are lower-cased before; UTF-8 writes U+00C0 to U+00FF with a lead byte of C3.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One run in so many loses a code point; the least length and count of a word.
MISSPELT, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: Words of a shard; entries of a task's counts before they are sent on; bytes of a block of rectangles.
SHARD_WORDS, COUNTS, BLOCK_BYTES = 20_000, 400_000, 16 << 20


def variants(doc_id: int | None, text: bytes) -> Iterator[tuple[bytes, int]]:
    """Words of a text with their counts, misspelt where the hash of document and run says so."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.lower())).items():
        h = zlib.crc32(run, seed)
        if h % MISSPELT == 0:
            word = run.decode()
            at = h % len(word)
            run = (word[:at] + word[at + 1 :]).encode()
        yield run, n


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n over all texts, words of the least length and count or more."""

    def send(total: dict[bytes, int]) -> pa.RecordBatch:
        kept = [(w, n) for w, n in total.items() if len(w) >= LEAST_LENGTH and len(w) - w.count(b"\xc3") >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for batch in batches:
            for a, b in slices(batch.column("text")):
                rows = batch.slice(a, b - a)
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist()):
                    for word, n in variants(doc_id, text or b""):
                        total[word] = total.get(word, 0) + n
                if len(total) > COUNTS:
                    yield send(total)
                    total = {}
        yield send(total)

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Shard:
    """The words of a shard that have one length, in both orders."""

    def __init__(self, words: list[bytes], counts: np.ndarray) -> None:
        self.width = len(words[0])
        chars = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), self.width)
        order = np.argsort(_strings(chars), kind="stable")
        self.chars, self.counts = chars[order], counts[order]
        self.forward = _strings(self.chars)
        back = np.ascontiguousarray(self.chars[:, ::-1])
        self.by_reverse = np.argsort(_strings(back), kind="stable")
        self.reverse = _strings(back[self.by_reverse])
        rank = np.empty(len(words), np.int64)
        rank[self.by_reverse] = np.arange(len(words))
        self.tree = WaveletTree(rank)


def _strings(chars: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(chars).view(f"S{chars.shape[1]}").ravel()


def _interval(ordered: np.ndarray, chars: np.ndarray, fixed: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The interval of ``ordered`` that starts with the first ``fixed`` characters of each row."""
    low = np.zeros((len(chars), width), np.uint8)
    k = min(width, chars.shape[1])
    low[:, :k] = chars[:, :k]
    free = np.arange(width) >= fixed[:, None]
    low[free] = 0
    left = np.searchsorted(ordered, _strings(low), "left")
    low[free] = 255
    return left, np.searchsorted(ordered, _strings(low), "right")


def _reported(shard: Shard, asked: np.ndarray, places: Callable[[int], range], grows: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of ``asked``, word of the shard, place) one replacement, or one insertion, away."""
    length = asked.shape[1]
    span = places(length)
    gone = 0 if grows else 1
    # an interval that holds no more than the word itself, if this is its shard, has nothing to report
    own = np.zeros(len(asked), np.int64)
    if not grows:
        mine = _strings(asked)
        own += shard.forward[np.minimum(np.searchsorted(shard.forward, mine), len(shard.forward) - 1)] == mine
    left, right = _interval(shard.forward, asked, np.full(len(asked), span.start), shard.width)
    rows = np.flatnonzero(right - left > own)
    step = max(1, BLOCK_BYTES // (8 * shard.width))
    for first in range(0, len(rows) * len(span), step):
        flat = np.arange(first, min(first + step, len(rows) * len(span)))
        row, place = rows[flat // len(span)], span.start + flat % len(span)
        left, right = _interval(shard.forward, asked[row], place, shard.width)
        some = np.flatnonzero(right - left > own[row])
        row, place, left, right = row[some], place[some], left[some], right[some]
        if not len(row):
            continue
        low, high = _interval(shard.reverse, asked[row][:, ::-1], length - place - gone, shard.width)
        q, value = shard.tree.report(left, right, low, high)
        yield row[q], shard.by_reverse[value], place[q]


def near_words(words: dict[int, Shard], asked: dict[int, tuple[np.ndarray, np.ndarray]], back: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (word, near word, its n), as bytes of Latin-1.

    ``asked`` has characters and counts of the asking words by length; in the
    backward direction all words are reversed.  Of the places at which a
    character can go into a run of its like, the last one of the word counts.
    """
    half = (lambda n: n - n // 2) if back else (lambda n: n // 2)
    for length, (chars, counts) in asked.items():
        if shard := words.get(length):
            for row, hit, _ in _reported(shard, chars, lambda n: range(half(n), n), False):
                other = (chars[row] != shard.chars[hit]).any(axis=1)
                yield chars[row[other]], shard.chars[hit[other]], shard.counts[hit[other]]
        if shard := words.get(length + 1):
            for row, hit, place in _reported(shard, chars, lambda n: range(half(n) + back, n + 1), True):
                put = shard.chars[hit, place]
                beside = chars[row, place - 1] if back else np.where(place < length, chars[row, np.minimum(place, length - 1)], 0)
                once = put != beside
                row, hit = row[once], hit[once]
                yield chars[row], shard.chars[hit], shard.counts[hit]
                yield shard.chars[hit], chars[row], counts[row]


def _by_length(table: pa.Table) -> dict[int, tuple[list[bytes], np.ndarray]]:
    words = [w.encode("latin-1") for w in table.column("s").to_pylist()]
    n = table.column("n").to_numpy()
    lens = np.array([len(w) for w in words])
    return {int(k): ([words[i] for i in at], n[at]) for k in np.unique(lens) for at in [np.flatnonzero(lens == k)]}


def _pairs(keep: Callable[[DataFrame, str], DataFrame], words: DataFrame, shards: int, back: bool) -> DataFrame:
    """(word, near, near_n) whose edit lies in the second half, or in the first one if ``back``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), *batch.columns], names=["part", "s", "n"])

    name = "back" if back else "forth"
    turned = words.select((F.reverse("word") if back else F.col("word")).alias("s"), "n")
    dealt = keep(turned.repartitionByRange(shards, "s").mapInArrow(deal, "part int, s string, n long"), f"spelling-{name}")
    bounds = sorted(dealt.groupBy("part").agg(F.min("s").alias("a"), F.max("s").alias("z")).collect(), key=lambda r: r["a"])
    parts, mins, maxs = [r["part"] for r in bounds], [r["a"] for r in bounds], [r["z"] for r in bounds]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, at = [], []
            for i, s in enumerate(batch.column("s").to_pylist()):
                shared = s[: len(s) - len(s) // 2 if back else len(s) // 2]
                for k in range(bisect_left(maxs, shared), bisect_left(mins, shared + "Ā")):
                    to.append(parts[k])
                    at.append(i)
            took = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), took.column("s"), took.column("n")], names=["part", "s", "n"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        words = {k: Shard(w, n) for k, (w, n) in _by_length(left).items()}
        asked = {k: (np.frombuffer(b"".join(w), np.uint8).reshape(len(w), k), n) for k, (w, n) in _by_length(right).items()}
        out: list[tuple[list[str], list[str], np.ndarray]] = []
        for a, b, n in near_words(words, asked, back):
            turn = slice(None, None, -1 if back else 1)
            out.append(([x.tobytes().decode("latin-1") for x in a[:, turn]], [x.tobytes().decode("latin-1") for x in b[:, turn]], n))
        return pa.table({"word": pa.array([w for a, _, _ in out for w in a], pa.string()), "near": pa.array([w for _, b, _ in out for w in b], pa.string()), "near_n": pa.array([int(x) for _, _, n in out for x in n], pa.int64())})

    asked = dealt.select("s", "n").mapInArrow(route, "part int, s string, n long")
    return dealt.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(search, "word string, near string, near_n long")


def _roots(keep: Callable[[DataFrame, str], DataFrame], forms: DataFrame) -> DataFrame:
    """(word, root) of the words of ``forms`` (word, form): pointers double until none moves.

    A form has at least twice the count of its word, so chains end, and after
    rounds logarithmic in their length.
    """
    at = keep(forms.select("word", F.col("form").alias("root")), "spelling-root")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = keep(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-root")
        at = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return at


def spelling_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of ``docs`` (doc_id, text).

    Null and empty texts have no words; a null doc_id is hashed as an empty one;
    repeated rows count again; of near words with equal counts the smallest in
    code-point order is the form.  Other columns play no part, and a table
    without words gives none.
    """
    with scratch(docs.sparkSession) as keep:
        words = keep(word_counts(docs), "spelling-words")
        shards = max(1, -(-words.count() // SHARD_WORDS))
        pairs = _pairs(keep, words, shards, False).unionAll(_pairs(keep, words, shards, True))
        best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        met = words.join(best, "word", "left").withColumn("larger", -F.col("best.less") >= 2 * F.col("n"))
        met = keep(met.select("word", F.expr("if(larger, best.near, null)").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr("if(larger, -best.less, null)").alias("form_n")), "spelling-forms")
        roots = _roots(keep, met.filter("form is not null"))
        out = met.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return materialize(out, "spelling")
