"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source takes complete epochs of its documents first.  What remains of its
target goes to the documents with the smallest exponential keys, -ln(u) / weight,
up to the remaining words.  The prefix sums run over key buckets, first of equal
ratio, then of equal width within the one that holds the last selected document,
and inside one of those per source only, so that no source is sorted in one task
whatever the weights.  Weights are the quality of the documents, a naive Bayes
score over binned features that labelled documents teach.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.llm.small import small
from tessera.runtime import materialize

#: A word, and the weights of the sources in name order, repeated.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Key buckets of a doubling of the key, and parts of the one at the boundary.
LEVELS, STEPS = 64, 4096
#: Bins of a quality feature, and the smallest weight.
BINS, LEAST = 16, 0.05


def words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def features(text: Column) -> Column:
    """Bins of a text: shares of odd marks, of distinct words, of stops and of spaces, and mean word length."""
    body = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(body), F.lit(1))
    parts = F.split(body, r"[\x20\x09-\x0D]+")
    count = F.greatest(F.size(parts), F.lit(1))
    without = lambda marks: F.length(body) - F.length(F.translate(body, marks, ""))
    shares = [1 - F.exp(-20 * without("*&%$#!|<>{}") / size), F.size(F.array_distinct(parts)) / count, without(".?!") / count, 2 * count / size, F.length(body) / count / 20]
    return F.array(*[F.least(F.floor(x * BINS), F.lit(BINS - 1)).cast("int") for x in shares])


def quality(binned: DataFrame, labels: DataFrame) -> Callable[[Column], Column]:
    """Weights in [0.05, 1] of bins, taught by ``binned`` (doc_id, bins) and ``labels`` (doc_id, quality).

    The weight is the probability of quality 1 by the counts of the labelled
    documents in each feature's bins, one added to each.  All labelled documents
    teach; a doc_id with several labels has the smallest.  Null labels and ids
    teach nothing; without documents of both labels all weights are 1.  The
    driver holds the bins.
    """
    said = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    known = binned.join(said, "doc_id").select((F.col("quality") > 0).alias("good"), F.posexplode("bins").alias("feature", "bin"))
    seen = {(r["feature"], r["bin"], r["good"]): r["n"] for r in known.groupBy("feature", "bin", "good").agg(F.count("*").alias("n")).collect()}
    total = {g: sum(n for (f, _, x), n in seen.items() if f == 0 and x is g) for g in (True, False)}

    def weight(bins: Column) -> Column:
        if not all(total.values()):
            return F.lit(1.0)
        odds = F.lit(math.log(total[True] / total[False]))
        for f in sorted({f for f, _, _ in seen}):
            logs = [math.log((seen.get((f, b, True), 0) + 1) / (total[True] + BINS)) - math.log((seen.get((f, b, False), 0) + 1) / (total[False] + BINS)) for b in range(BINS)]
            odds = odds + F.get(F.array(*[F.lit(x) for x in logs]), F.get(bins, F.lit(f)))
        return F.greatest(F.lit(LEAST), 1 / (1 + F.exp(-odds)))

    return weight


def drawn_key(ident: Column, weight: Column, seed: str) -> Column:
    """The exponential key of a document; the same in every run."""
    u = (F.pmod(F.xxhash64(F.coalesce(ident.cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def _place(key: Column) -> tuple[Column, Column]:
    """Level and step of a key; both together rise with the key."""
    x = F.log2(key) * LEVELS
    return F.floor(x).cast("int"), F.floor((x - F.floor(x)) * STEPS).cast("int")


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """Add ``target`` to ``sizes`` (source, source_size), one row per source.

    Targets are in proportion to the weights and add up to ``share`` of all
    sizes; none is above ``most`` times its source.  Sorted by the level at
    which each is full, the full ones are those below the level that the words
    left give to the rest.
    """
    all_rows = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS)).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("full", F.col("source_size") * float(most))
    order = W.orderBy(F.col("full") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("full").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(all_rows) * float(share)
    leveled = ranked.withColumn("level", (total - before) / rest).withColumn("is_full", F.col("full") / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("is_full"), F.col("level"))).over(all_rows)
    return leveled.withColumn("target", F.when(F.col("is_full"), F.col("full")).otherwise(level * F.col("weight"))).select("source", "source_size", "target")


def cutoffs(drawn: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source of ``drawn`` (ident, source, size, key).

    ``source``, ``source_size``, ``target``, ``epochs`` and the last selected
    (key, ident text, size) of the fractional epoch as ``cut``, null where it
    selects none.  A document is selected when its middle word is within the
    words that remain, so a source is off its target by half a document at most.
    """
    sizes = drawn.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, share, most)
    aims = aims.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    aims = materialize(aims.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-aims")
    level, step = _place(F.col("key"))
    drawn = drawn.select("source", "size", "key", F.coalesce(F.col("ident").cast("string"), F.lit("")).alias("ident"), level.alias("level"), step.alias("step"))
    same = F.col("o.source").eqNullSafe(F.col("a.source"))

    def edge(rows: DataFrame, start: DataFrame, by: str) -> DataFrame:
        """The last of the buckets ``by`` that begins within the words that remain."""
        sums = rows.groupBy("source", by).agg(F.sum("size").alias("words"))
        before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        met = sums.select("source", by, before.alias("before")).alias("o").join(small(start.alias("a"), start), same).withColumn("first", F.col("o.before") + F.col("a.base"))
        kept = [c for c in start.columns if c not in ("source", "base")]
        return met.filter("first < rest").groupBy("a.source", *[f"a.{c}" for c in kept]).agg(F.max(F.struct(F.col(f"o.{by}").alias("at"), F.col("first"))).alias("e")).select("source", *kept, F.col("e.at").alias(by), F.col("e.first").alias("base"))

    levels = materialize(edge(drawn, aims.select("source", "rest", F.lit(0).cast("long").alias("base")), "level"), "mix-levels")
    inside = drawn.alias("d").join(small(levels.alias("a"), levels), F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.level") == F.col("a.level")))
    inside = materialize(inside.select("d.*"), "mix-inside")
    steps = materialize(edge(inside, levels, "step"), "mix-steps")
    last = inside.alias("d").join(small(steps.alias("a"), steps), F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.step") == F.col("a.step"))).select("d.source", "key", "ident", "size", "base", "rest")
    at = W.partitionBy("source").orderBy("key", "ident", "size").rowsBetween(W.unboundedPreceding, -1)
    reach = F.col("base") + F.coalesce(F.sum("size").over(at), F.lit(0)) + F.col("size") / 2
    cut = last.withColumn("in", reach <= F.col("rest")).groupBy("source").agg(F.max(F.when(F.col("in"), F.struct("key", "ident", "size"))).alias("cut"))
    # where the last bucket selects none, all buckets before it are in
    cut = cut.alias("c").join(steps.alias("e"), F.col("c.source").eqNullSafe(F.col("e.source"))).select("e.source", "cut", "e.level", "e.step")
    return materialize(aims.alias("a").join(cut.alias("c"), F.col("a.source").eqNullSafe(F.col("c.source")), "left").select("a.source", "source_size", "target", "epochs", "cut", "level", "step"), "mix-cut")


def copies(key: Column, ident: Column, size: Column) -> Column:
    """How often a document is taken, beside the columns of ``cutoffs``."""
    place, edge = F.struct(*_place(key)), F.struct("c.level", "c.step")
    here = F.struct(key.alias("key"), F.coalesce(ident.cast("string"), F.lit("")).alias("ident"), size.alias("size"))
    inside = F.col("c.level").isNotNull() & ((place < edge) | ((place == edge) & F.coalesce(here <= F.col("c.cut"), F.lit(False))))
    return F.coalesce(F.col("c.epochs"), F.lit(0)) + F.when(inside, 1).otherwise(0)


def _drawn(docs: DataFrame, labels: DataFrame | None, seed: str) -> tuple[DataFrame, Callable[[Column, Column], Column]]:
    """ident, source, size and key of the rows of ``docs``, and the key of an id and bins."""
    rows = docs.select(F.col("doc_id").alias("ident"), "source", words(F.col("text")).alias("size"), features(F.col("text")).alias("bins"))
    rows = materialize(rows, "mix-drawn")
    weight = (lambda bins: F.lit(1.0)) if labels is None else quality(rows.select(F.col("ident").alias("doc_id"), "bins"), labels)
    key = lambda ident, bins: drawn_key(ident, weight(bins), seed)
    return rows.select("ident", "source", "size", key(F.col("ident"), F.col("bins")).alias("key")), key


def mix(docs: DataFrame, labels: DataFrame | None = None, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """Take ``docs`` (doc_id, text, source) to the targets of their sources.

    ``labels`` teach the ``quality`` that weighs a document among those of its
    source; without them all weigh 1.  Returns doc_id, source, size, source_size,
    target, copies, taken and key, one row per row.  Null texts and texts without
    words have size 0 and take nothing; a null source is a source of its own, the
    last; rows that repeat an id are drawn by the same number.  Other columns
    play no part; an empty table gives none.
    """
    drawn, _ = _drawn(docs, labels, seed)
    cut = cutoffs(drawn, share, most)
    joined = drawn.alias("d").join(small(cut.alias("c"), cut), F.col("d.source").eqNullSafe(F.col("c.source")))
    out = joined.withColumn("copies", copies(F.col("d.key"), F.col("d.ident"), F.col("d.size")))
    return out.select(F.col("ident").alias("doc_id"), "d.source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "key")


def repeated(docs: DataFrame, labels: DataFrame | None = None, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it, columns unchanged."""
    drawn, key = _drawn(docs, labels, seed)
    cut = cutoffs(drawn, share, most)
    # the rows lie in a struct, so none of their names meets one of the columns here
    bins = F.lit(None).cast("array<int>") if labels is None else features(F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), words(F.col("text")).alias("row_size"), bins.alias("row_bins"))
    joined = rows.join(small(cut.alias("c"), cut), F.col("row.source").eqNullSafe(F.col("c.source")))
    times = copies(key(F.col("row.doc_id"), F.col("row_bins")), F.col("row.doc_id"), F.col("row_size"))
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("copy")).select("row.*")
