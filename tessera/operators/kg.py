"""The temporal knowledge graph: facts with an interval of validity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.text import canonical_time, end_key, entity_id, predicate_id, start_key
from tessera.runtime import materialize, small


def _id(name: str) -> str:
    """``entity_id`` of a literal."""
    return name.lower().replace(" ", "_").replace("'", "")


def valid_at(when: str) -> Column:
    """Whether a fact's interval holds a time; a missing bound is open.

    A date counts from its first second, for either bound.
    """
    t = canonical_time(when)
    key = F.lit(t if len(t) > 10 else f"{t}T00:00:00Z")
    return (F.col("valid_from").isNull() | (start_key(F.col("valid_from")) <= key)) & (F.col("valid_to").isNull() | (end_key(F.col("valid_to")) >= key))


def facts(triples: DataFrame, entities: DataFrame, name: str, direction: str = "both", as_of: str | None = None) -> DataFrame:
    """Facts of an entity: direction, subject, predicate, object, bounds, current.

    The entity's own side is the name asked for, the other side the stored name;
    facts whose other side isn't stored don't count.  A fact is current while
    it has no end at all.
    """
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError(f"direction: {direction!r}")
    if not name:
        raise ValueError("an entity needs a name")
    live = triples if as_of is None else triples.filter(valid_at(as_of))
    names = entities.select(F.col("id").alias("_id"), "name")
    rows = []
    for way, own, other in (("outgoing", "subject", "object"), ("incoming", "object", "subject")):
        if direction in (way, "both"):
            found = live.filter(F.col(own) == _id(name)).join(names, F.col(other) == F.col("_id"))
            ends = {own: F.lit(name), other: F.col("name")}
            rows.append(found.select(F.lit(way).alias("direction"), ends["subject"].alias("subject"), "predicate", ends["object"].alias("object"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("current")))
    return rows[0] if len(rows) == 1 else rows[0].unionAll(rows[1])


#: Days of the calendar that intervals are cut by, as a power of two, and the first of them; earlier and later ones share the first and last.
LEVELS, DAY_ONE = 16, "1900-01-01"
#: Facts of an entity up to which each time meets all of them.
FEW = 64
_FACT = ("id", "predicate", "other", "valid_from", "valid_to")


def _day(time: Column) -> Column:
    """The number of a day in the calendar; null if the text doesn't start with a date."""
    date = F.try_to_date(F.substring(time, 1, 10))
    return F.when(date.isNotNull(), F.least(F.greatest(F.date_diff(date, F.lit(DAY_ONE).cast("date")), F.lit(0)), F.lit((1 << LEVELS) - 1)))


def as_of_many(triples: DataFrame, asked: DataFrame, direction: str = "outgoing") -> DataFrame:
    """Facts that hold for each of many (entity, at): the rows of ``asked`` with id, predicate, other, valid_from, valid_to.

    ``entity`` is an id and ``at`` a date or UTC time, as in ``valid_at``; a null
    in either finds nothing, and repeated rows find their facts again.  A time
    meets all facts of an entity that has few.  For the others an interval goes to the nodes of a binary calendar that cover it, two a level at
    most, and a time to the nodes above its day, so a pair of them meets once and
    neither long intervals nor entities with many facts make all pairs.
    """
    if direction not in ("outgoing", "incoming"):
        raise ValueError(f"direction: {direction!r}")
    own, other = ("subject", "object") if direction == "outgoing" else ("object", "subject")
    top = 1 << LEVELS
    first, last = F.coalesce(_day(F.col("valid_from")), F.lit(0)) + top, F.coalesce(_day(F.col("valid_to")), F.lit(top - 1)) + top + 1
    nodes = []
    for k in range(LEVELS + 1):
        a, z = F.expr(f"shiftright(_a + {(1 << k) - 1}, {k})"), F.expr(f"shiftright(_z, {k})")
        nodes += [F.when((a < z) & (a % 2 == 1), a), F.when((a < z) & (z % 2 == 1), z - 1)]
    facts = triples.select("id", F.col(own).alias("entity"), "predicate", F.col(other).alias("other"), "valid_from", "valid_to")
    time = F.regexp_replace("at", r"\+00:00$", "Z")
    times = asked.withColumn("_key", start_key(time)).filter(_day(F.col("at")).isNotNull())
    many = materialize(facts.groupBy("entity").agg(F.count("*").alias("_k")).filter(F.col("_k") > FEW).select("entity"), "kg-many")
    near = times.join(facts.join(small(many), "entity", "left_anti"), "entity").select(*asked.columns, "_key", *_FACT)
    facts, times = (x.join(small(many), "entity", "left_semi") for x in (facts, times))
    cover = facts.select("*", first.alias("_a"), last.alias("_z"))
    cover = cover.withColumn("_node", F.explode(F.filter(F.array(*nodes), lambda x: x.isNotNull()))).drop("_a", "_z")
    point = times.withColumn("_node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.call_function("shiftright", _day(F.col("at")) + top, k))))
    met = point.join(cover, ["entity", "_node"]).select(*asked.columns, "_key", *_FACT)
    holds = (F.col("valid_from").isNull() | (start_key(F.col("valid_from")) <= F.col("_key"))) & (F.col("valid_to").isNull() | (end_key(F.col("valid_to")) >= F.col("_key")))
    return near.unionAll(met).filter(holds).select(*asked.columns, *_FACT)


def relationship(triples: DataFrame, entities: DataFrame, subject: str, predicate: str) -> DataFrame:
    """Objects of a subject and predicate."""
    found = triples.filter((F.col("subject") == _id(subject)) & (F.col("predicate") == predicate.lower().replace(" ", "_")))
    return found.join(entities.select(F.col("id").alias("object"), "name"), "object").select(F.lit(subject).alias("subject"), "predicate", F.col("name").alias("object"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("current"))


def timeline(triples: DataFrame, entities: DataFrame, name: str | None = None, limit: int = 100) -> DataFrame:
    """Facts by start, those without one first; all of an entity, else the first ``limit``."""
    ends = lambda side: entities.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"))
    rows = triples if name is None else triples.filter((F.col("subject") == _id(name)) | (F.col("object") == _id(name)))
    rows = rows.join(ends("subject"), "subject").join(ends("object"), "object")
    rows = rows.orderBy(F.col("valid_from").asc_nulls_first(), "id")
    rows = rows.limit(limit) if name is None else rows
    return rows.select("id", F.col("subject_name").alias("subject"), "predicate", F.col("object_name").alias("object"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("current"))


def statistics(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: entities, facts, current and expired ones, and the predicates."""
    t = triples.agg(F.count("*").alias("triples"), F.count_if(F.col("valid_to").isNull()).alias("current"), F.count_if(F.col("valid_to").isNotNull()).alias("expired"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("predicates"))
    return t.crossJoin(entities.agg(F.count("*").alias("entities")))


def current_of_wing(triples: DataFrame, drawers: DataFrame, wing: str, limit: int = 20) -> DataFrame:
    """Distinct current (subject, predicate) of facts whose drawer lies in a wing."""
    of = drawers.filter(F.col("wing") == wing).select(F.col("id").alias("source_drawer_id"))
    return triples.filter("valid_to is null").join(of, "source_drawer_id", "left_semi").select("subject", "predicate").distinct().orderBy("subject", "predicate").limit(limit)


def add_facts(triples: DataFrame, new: DataFrame) -> DataFrame:
    """The facts of ``new`` (subject, predicate, object, valid_from, valid_to, confidence) to append.

    Names become ids.  Rows with a confidence outside 0 to 1, a start after the
    end, or an open fact of the same subject, predicate and object stored already
    or earlier in ``new`` are left out.
    """
    named = new.withColumns({"subject": entity_id(F.col("subject")), "predicate": predicate_id(F.col("predicate")), "object": entity_id(F.col("object"))})
    sound = F.col("confidence").between(0, 1) & ~F.isnan("confidence")
    order = F.col("valid_from").isNull() | F.col("valid_to").isNull() | (start_key(F.col("valid_from")) <= end_key(F.col("valid_to")))
    key = ["subject", "predicate", "object"]
    rows = named.filter(sound & order).join(triples.filter("valid_to is null").select(*key), key, "left_anti")
    ident = F.concat(F.lit("t_"), F.substring(F.sha2(F.concat_ws("\u001f", *key, F.coalesce("valid_from", F.lit(""))).cast("binary"), 256), 1, 16))
    return rows.dropDuplicates(key).withColumn("id", ident)


def new_entities(entities: DataFrame, facts_to_add: DataFrame) -> DataFrame:
    """Entities that new facts name and ``entities`` lacks, of unknown type."""
    ends = facts_to_add.select(F.col("subject").alias("id")).union(facts_to_add.select(F.col("object").alias("id"))).distinct()
    return ends.join(entities, "id", "left_anti").select("id", F.col("id").alias("name"), F.lit("unknown").alias("type"))


def invalidate(triples: DataFrame, subject: str, predicate: str, object_: str, ended: str) -> DataFrame:
    """``triples`` with an end for the open facts of a subject, predicate and object.

    Facts that start after the end stay open.
    """
    end = canonical_time(ended)
    last = end if len(end) > 10 else f"{end}T23:59:59Z"
    mine = (F.col("subject") == _id(subject)) & (F.col("predicate") == predicate.lower().replace(" ", "_")) & (F.col("object") == _id(object_))
    right = F.col("valid_from").isNull() | (start_key(F.col("valid_from")) <= last)
    return triples.withColumn("valid_to", F.when(mine & F.col("valid_to").isNull() & right, end).otherwise(F.col("valid_to")))


def check_confidence(value: float) -> float:
    """A confidence as given, or a ValueError."""
    if math.isnan(value) or not 0 <= value <= 1:
        raise ValueError(f"confidence: {value}")
    return value
