"""Personal data by patterns and by contexts that the patterns teach.

Base matches of four kinds seed the search.  Every match and every other token
with a digit or an at sign is an instance with a shape; the two words before
it are its pattern.  Confidence flows between patterns and shapes for a few
rounds, and tokens that both a confident pattern and a confident shape support
are added.  All steps are DataFrame expressions; a text is read once, and what
is joined or grouped later is a few rows per identifier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.small import small
from tessera.runtime import materialize

#: The kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
#: The four base patterns.  Possessive quantifiers and the test before the first
#: character keep each from rescanning a run; what is found is the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Zeros in front give back the last one, which may be the whole part.
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A token with a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
BLOCK = 512


def _blocks(items: Column) -> Column:
    """Numbers from 0 of the blocks of a list that isn't empty."""
    return F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ends(found: Column) -> Column:
    """Structs (start, end, text, left) from (gap, n, text, left) in text order.

    Sums run within blocks, and blocks start from the sum of those before, so
    that long lists don't copy a growing list for each item.
    """
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<struct<start:long,end:long,text:string,left:string>>")

    def block(b: Column) -> Column:
        base = F.aggregate(F.slice(found, 1, b * BLOCK), zero, lambda a, x: a + x["gap"] + x["n"])

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            row = F.struct(start.alias("start"), (start + x["n"]).alias("end"), x["text"].alias("text"), x["left"].alias("left"))
            return F.struct((start + x["n"]).alias("at"), F.concat(acc["rows"], F.array(row)).alias("rows"))

        return F.aggregate(F.slice(found, b * BLOCK + 1, BLOCK), F.struct(base.alias("at"), empty.alias("rows")), step, lambda acc: acc["rows"])

    return F.when(F.size(found) > 0, F.flatten(F.transform(_blocks(found), block))).otherwise(empty)


def _measured(matches: Column, gaps: Column) -> Column:
    """Structs (gap, n, text, left) of matches and the texts between them."""

    def row(m: Column, i: Column) -> Column:
        gap = F.get(gaps, i)
        return F.struct(F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("n"), m.alias("text"), _left(gap).alias("left"))

    return F.transform(matches, row)


def _kept(ended: Column, kind: str) -> Column:
    """The matches that hold as structs (kind, start, end, text, left)."""
    holding = F.filter(ended, lambda x: _holds(kind, x["text"]))
    number = F.lit(KINDS.index(kind)).alias("kind")
    return F.transform(holding, lambda x: F.struct(number, x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["left"].alias("left")))


def _left(gap: Column) -> Column:
    """The last two words before an identifier, in small letters, one space between.

    The end of the text before it is enough where it holds two whole words.
    """
    end = F.concat(F.lit(" "), F.right(gap, F.lit(48)))
    cut = (F.length(gap) > 48) & ~F.substring(end, 2, 48).rlike(r"\s\S+\s+\S+\s*$")
    words = F.substring_index(F.rtrim(F.regexp_replace(gap, r"\s+", " ")), " ", -2)
    short = F.regexp_extract(end, r"((?:\s\S+)?\s\S+)\s*$", 1)
    return F.lower(F.trim(F.when(cut, words).otherwise(F.regexp_replace(short, r"\s+", " "))))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, text: Column) -> Column:
    if kind == "ip":
        return text.rlike(rf"^{IP_PART}\.{IP_PART}\.{IP_PART}\.{IP_PART}$")
    if kind == "card":
        return F.length(_digits(text)).between(16, 19) & luhn(_digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _shape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[0-9]+", "9"), r"\p{L}+", "a")


def find_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base`` and ``tokens`` to ``docs``: structs (kind, start, end, text, left).

    Offsets are code points, ends exclusive.  ``tokens`` are all tokens
    with a digit or an at sign that touch no base match; their kind is -1.
    Whole texts are searched; a null text has none.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    guard = {"email": F.contains(body, F.lit("@")), "phone": F.contains(body, F.lit("+"))}
    none = F.array().cast("array<string>")
    patterns = BASE | {"token": TOKEN}
    out = docs.withColumns({f"_m_{k}": F.when(guard.get(k, F.lit(True)), F.regexp_extract_all(body, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    out = out.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, F.split(body, p, -1)).otherwise(none) for k, p in patterns.items()})
    out = out.withColumns({f"_f_{k}": _measured(F.col(f"_m_{k}"), F.col(f"_g_{k}")) for k in patterns})
    out = out.withColumns({f"_e_{k}": _ends(F.col(f"_f_{k}")) for k in patterns})
    out = out.withColumn("base", F.concat(*[_kept(F.col(f"_e_{k}"), k) for k in KINDS]))

    def trimmed(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["text"], r"^[(\[<\"']*", 0))
        core = F.regexp_replace(F.substring(x["text"], lead + 1, F.length(x["text"])), r"[.,;:!?)\]>\"']+$", "")
        return F.struct(F.lit(-1).alias("kind"), (x["start"] + lead).alias("start"), (x["start"] + lead + F.length(core)).alias("end"), core.alias("text"), x["left"].alias("left"))

    def apart(b: Column) -> Column:
        """The tokens of a block that touch none of the base matches in its range."""
        block = F.slice("_e_token", b * BLOCK + 1, F.lit(BLOCK))
        first, last = F.get(block, F.lit(0))["start"], F.element_at(block, -1)["end"]
        range_ = F.struct(block.alias("block"), first.alias("first"), last.alias("last"))
        near = lambda r: F.struct(r["block"].alias("block"), F.filter(F.col("base"), lambda x: (x["start"] < r["last"]) & (r["first"] < x["end"])).alias("near"))
        free = lambda r: F.filter(F.transform(r["block"], trimmed), lambda x: (F.length(x["text"]) > 0) & ~F.exists(r["near"], lambda m: (m["start"] < x["end"]) & (x["start"] < m["end"])))
        return _bound(_bound(range_, near), free)

    some = F.size("_e_token") > 0
    free = F.when(some, F.flatten(F.transform(_blocks(F.col("_e_token")), apart))).otherwise(F.transform("_e_token", trimmed))
    out = out.withColumn("tokens", free)
    return out.drop(*[f"_{a}_{k}" for a in "mgfe" for k in patterns])


def score_graph(instances: DataFrame, rounds: int = 3) -> DataFrame:
    """Confidence of each (kind, pattern, shape) of ``instances`` (kind, pattern, shape).

    Instances are counted by pattern and shape first, so a pattern or shape that
    a third of all instances share is one row per partner in what follows.  A
    shape starts from the share of its instances that are seeds of the kind.  In
    each round a pattern gets the mean confidence of its instances' shapes and a
    shape the mean of its instances' patterns, each shrunk by one instance
    without confidence; seeds keep confidence 1.  Means are over all instances,
    those of shapes without a seed included; rows that no confidence reaches are
    left out.  ``mean`` is the last mean of a shape, not shrunk: its patterns
    are, and a form seen once has the confidence of the one it stands behind.
    """
    counts = instances.groupBy("pattern", "shape").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == i).alias(f"s{i}") for i in range(len(KINDS))])
    edges = materialize(counts, "pii-edges")
    totals = {c: materialize(edges.groupBy(c).agg(F.sum("n").alias(f"{c}_n")), f"pii-{c}s") for c in ("pattern", "shape")}
    edges = edges.join(totals["pattern"], "pattern").join(small(totals["shape"]), "shape")
    edges = materialize(edges.select("pattern", "shape", "n", "pattern_n", "shape_n", F.array(*[f"s{i}" for i in range(len(KINDS))]).alias("by_kind")), "pii-edges")
    kinds = edges.select("shape", "shape_n", F.posexplode("by_kind").alias("kind", "seeds")).filter("seeds > 0")
    by_shape = kinds.groupBy("kind", "shape").agg((F.sum("seeds") / (F.first("shape_n") + 1)).alias("from_shape"))
    seeds = F.get("by_kind", F.col("kind"))
    given = lambda c: F.sum(seeds + (F.col("n") - seeds) * F.col(c))
    for _ in range(rounds):
        # a few shapes have most of the edges; their table is small unless counted otherwise
        by_shape = materialize(by_shape, "pii-shapes")
        by_pattern = edges.join(small(by_shape), "shape").groupBy("kind", "pattern").agg((given("from_shape") / (F.first("pattern_n") + 1)).alias("from_pattern"), F.sum(seeds).alias("support"))
        by_pattern = materialize(by_pattern, "pii-patterns")
        by_shape = edges.join(by_pattern, "pattern").groupBy("kind", "shape").agg((given("from_pattern") / (F.first("shape_n") + 1)).alias("from_shape"), (given("from_pattern") / F.first("shape_n")).alias("mean"))
    by_shape = materialize(by_shape, "pii-shapes")
    graph = edges.join(by_pattern, "pattern").join(small(by_shape), ["kind", "shape"])
    return graph.select("kind", "pattern", "shape", "n", seeds.alias("seeds"), "from_pattern", "support", "from_shape", "mean")


def discover(found: DataFrame, key: list[str], least: float = 0.6, support: int = 3, rounds: int = 3) -> DataFrame:
    """Spans that the contexts add to ``found`` (``key``, base, tokens), by key.

    A token is added when its pattern has ``support`` seeds of the kind at least
    and the confidence of the pattern and the mean of the shape both reach
    ``least``; among kinds the surest wins, then the first listed.  Returns
    ``key`` and ``added``, one row per key that gains spans; repeated rows of a
    key count once.
    """
    flat = lambda c: found.select(*key, F.explode(c).alias("x")).select(*key, "x.kind", "x.start", "x.end", F.col("x.left").alias("pattern"), _shape(F.col("x.text")).alias("shape"))
    tokens = flat("tokens").filter("pattern <> ''")
    graph = score_graph(flat("base").filter("pattern <> ''").select("kind", "pattern", "shape").unionAll(tokens.select("kind", "pattern", "shape")), rounds)
    sure = graph.filter((F.col("n") > F.col("seeds")) & (F.col("support") >= support) & (F.least("from_pattern", "mean") >= least))
    best = sure.groupBy("pattern", "shape").agg(F.max(F.struct((F.col("from_pattern") * F.col("mean")).alias("c"), (-F.col("kind")).alias("k"))).alias("b")).select("pattern", "shape", (-F.col("b.k")).alias("found"))
    hits = tokens.join(best, ["pattern", "shape"])
    return hits.groupBy(*key).agg(F.collect_set(F.struct(F.col("found").alias("kind"), "start", "end")).alias("added"))


def spans_of(docs: DataFrame, text: str = "text", ident: str = "doc_id", **settings) -> tuple[DataFrame, list[str]]:
    """One row per row of ``docs``: ident, text_hash, base and added spans.

    The result is kept in the shared folder; rows that repeat ident and text
    repeat the result.  Returns it and the names of its key columns.
    """
    key = [ident, "text_hash"]
    narrow = docs.select(F.col(ident), F.col(text).alias("_text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    kept = materialize(find_base(narrow, "_text").select(*key, "base", "tokens"), "pii-found")
    # a token is a few rows per document; the join below is on the key of a document
    added = discover(kept, key, **settings)
    pairs = kept.select(*key, F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("base"))
    none = F.array().cast("array<struct<kind:int,start:long,end:long>>")
    joined = pairs.alias("p").join(added.alias("a"), [F.col(f"p.{k}").eqNullSafe(F.col(f"a.{k}")) for k in key], "left")
    return joined.select(*[F.col(f"p.{k}").alias(k) for k in key], "base", F.coalesce("added", none).alias("added")), key


def written(spans: Column) -> Column:
    """kind:start:end of the spans, by kind as listed, then start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def mask(docs: DataFrame, text: str = "text", ident: str = "doc_id", **settings) -> DataFrame:
    """Replace every span of the texts of ``docs`` by its kind in brackets.

    Spans that overlap become one, named by the first.  Null and empty texts,
    columns, rows and repeated rows stay as they are.  A text is masked by blocks
    of spans, so that long lists don't walk it from its start for each.
    """
    spans, key = spans_of(docs, text, ident, **settings)
    cut = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = spans.select(F.col(ident).alias("of"), "text_hash", cut.alias("cut")).filter(F.size("cut") > 0).dropDuplicates(["of", "text_hash"])
    # the rows lie in a struct, so none of their names meets one of the columns here
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row_hash"))
    joined = rows.join(spans, F.col("row")[ident].eqNullSafe(F.col("of")) & (F.col("row_hash") == F.col("text_hash")), "left")
    body = F.col("row")[text]
    size = F.length(body).cast("long")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")

    def reach(n: Column) -> Column:
        """Where the first ``n`` spans end."""
        return F.coalesce(F.array_max(F.transform(F.slice("cut", F.lit(1), n), lambda s: s["end"])), zero)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(F.substring(acc["part"], (acc["at"] - acc["base"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.get(names, s["kind"]))
        parts = F.concat(acc["parts"], F.when(fresh, F.array(piece)).otherwise(none))
        return F.struct(acc["base"].alias("base"), acc["part"].alias("part"), F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    def block(b: Column) -> Column:
        """The masked text from the end of the blocks before to the end of this one."""
        ends = F.struct(reach(b * BLOCK).alias("base"), reach((b + 1) * BLOCK).alias("to"))

        def walk(e: Column) -> Column:
            part = F.substring(body, (e["base"] + 1).cast("int"), (e["to"] - e["base"]).cast("int"))
            start = F.struct(e["base"].alias("base"), part.alias("part"), e["base"].alias("at"), none.alias("parts"))
            return F.aggregate(F.slice("cut", b * BLOCK + 1, F.lit(BLOCK)), start, step, lambda acc: F.array_join(acc["parts"], ""))

        return _bound(ends, walk)

    tail = F.substring(body, (reach(F.size("cut")) + 1).cast("int"), size.cast("int"))
    done = F.concat(F.array_join(F.transform(_blocks(F.col("cut")), block), ""), tail)
    masked = F.when(F.col("cut").isNull(), body).otherwise(done)
    return joined.select(*[masked.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
