"""Rooms and wings as a graph, and links between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.functions.text import tunnel_id, wing_name
from tessera.operators.components import connected_components
from tessera.runtime import materialize

#: Rows that a traversal or a tunnel list shows.
SHOWN = 50


def room_nodes(drawers: DataFrame) -> DataFrame:
    """Rooms with their wings, sorted, and drawers; the catch-all room is left out."""
    return drawers.filter("room <> 'general' and room <> ''").groupBy("room").agg(F.array_sort(F.collect_set("wing")).alias("wings"), F.count("*").alias("n"))


def room_edges(nodes: DataFrame) -> DataFrame:
    """Pairs of wings that share a room, the smaller first."""
    later = F.transform("wings", lambda w, i: F.transform(F.slice(F.col("wings"), i + 2, F.size("wings")), lambda v: F.struct(w.alias("wing_a"), v.alias("wing_b"))))
    return nodes.select("room", "n", F.explode(F.flatten(later)).alias("e")).select("room", "e.wing_a", "e.wing_b", "n")


def traverse(nodes: DataFrame, start: str, hops: int) -> DataFrame:
    """Rooms within ``hops`` of a room, by hops; rooms that share a wing are neighbours.

    ``via`` holds the wings shared with the smallest-named room one hop nearer.
    A round joins the new rooms' wings, once each, with the rooms of those wings
    and drops the rooms that are known; it ends early when none is new.
    """
    at = nodes.select("room", F.explode("wings").alias("wing"))
    found = nodes.filter(F.col("room") == start).select("room", F.lit(0).alias("hop"), F.lit(None).cast("array<string>").alias("via"))
    seen = front = materialize(found, "hop-0")
    for hop in range(1, hops + 1):
        near = front.select(F.col("room").alias("from")).join(at.select(F.col("room").alias("from"), "wing"), "from")
        # a room's smallest neighbour is the smallest of its wings' smallest ones
        least = near.groupBy("wing").agg(F.min("from").alias("from"))
        step = least.join(at, "wing").join(seen.select("room"), "room", "left_anti")
        pairs = step.groupBy("room", "from").agg(F.array_sort(F.collect_set("wing")).alias("via"))
        new = pairs.groupBy("room").agg(F.lit(hop).alias("hop"), F.min_by("via", "from").alias("via"))
        front = materialize(new, f"hop-{hop}")
        if not front.limit(1).count():
            break
        seen = materialize(seen.unionByName(front), f"seen-{hop}")
    return seen.join(nodes, "room").select("room", "hop", "n", "wings", "via")


def shown(rows: DataFrame, *order) -> DataFrame:
    """The first rows by an order, each with whether more were found."""
    some = rows.orderBy(*order).limit(SHOWN + 1)
    numbered = some.withColumn("at", F.row_number().over(W.orderBy(*order)))
    return numbered.withColumn("truncated", F.max("at").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) > SHOWN).filter(F.col("at") <= SHOWN).drop("at")


def tunnels(nodes: DataFrame, wing_a: str | None = None, wing_b: str | None = None) -> DataFrame:
    """Rooms of two wings or more, optionally of given ones."""
    rows = nodes.filter(F.size("wings") >= 2)
    for w in (wing_a, wing_b):
        if w is not None:
            rows = rows.filter(F.array_contains("wings", w.lower().replace(" ", "_").replace("-", "_")))
    return rows


def statistics(nodes: DataFrame) -> DataFrame:
    """One row: rooms, tunnel rooms, edges, and wings."""
    k = F.size("wings")
    return nodes.agg(F.count("*").alias("rooms"), F.count_if(k >= 2).alias("tunnel_rooms"), F.sum((k * (k - 1) / 2).cast("long")).alias("edges"))


def rooms_per_wing(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode("wings").alias("wing")).groupBy("wing").agg(F.count("*").alias("rooms"))


def topic_tunnels(topics: DataFrame, least: int = 1) -> DataFrame:
    """Links of wings that share ``least`` topics or more, one a shared topic.

    Topics compare without case and surrounding space and keep the casing that
    comes first (by position) in the smaller wing.  Wings are normalised.
    """
    clean = topics.withColumns({"wing": wing_name(F.col("wing")), "key": F.lower(F.trim("topic")), "name": F.trim("topic")}).filter("key <> '' and wing <> ''")
    own = clean.groupBy("wing", "key").agg(F.min_by("name", "position").alias("name"))
    a, b = (own.select(F.col("wing").alias(f"wing_{x}"), "key", F.col("name").alias(f"name_{x}")) for x in "ab")
    pairs = a.join(b, "key").filter("wing_a < wing_b")
    enough = pairs.groupBy("wing_a", "wing_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= max(1, least))
    rows = pairs.join(enough, ["wing_a", "wing_b"])
    room = F.concat(F.lit("topic:"), F.col("name_a"))
    return rows.select(tunnel_id(F.col("wing_a"), room, F.col("wing_b"), room).alias("id"), "wing_a", "wing_b", room.alias("room"), F.concat(F.lit("shared topic: "), F.col("name_a")).alias("label"), F.lit("topic").alias("kind"), "shared")


def upsert_tunnels(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new``, which replace those of the same id."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def follow(links: DataFrame, wing: str, room: str) -> DataFrame:
    """Links of (wing, room) as seen from there; a link to itself counts as outgoing."""
    w = wing.lower().replace(" ", "_").replace("-", "_")
    is_a = (F.col("wing_a") == w) & (F.col("room_a") == room)
    is_b = (F.col("wing_b") == w) & (F.col("room_b") == room)
    out = links.filter(is_a).select("id", F.lit("outgoing").alias("direction"), F.col("wing_b").alias("wing"), F.col("room_b").alias("room"), "label")
    back = links.filter(is_b & ~is_a).select("id", F.lit("incoming").alias("direction"), F.col("wing_a").alias("wing"), F.col("room_a").alias("room"), "label")
    return out.unionAll(back)


def people(commits: DataFrame) -> DataFrame:
    """Authors by shared name or email, from ``commits`` (name, email, repo).

    Names and emails are the ends of edges; each component is a person, shown by
    the name with most commits, then the smallest.  Bots are left out.
    """
    human = commits.filter(~F.lower("name").rlike(r"\[bot\]|^dependabot|^renovate|bot$"))
    edge = human.select(F.xxhash64(F.concat(F.lit("n:"), F.lower("name"))).alias("u"), F.xxhash64(F.concat(F.lit("e:"), F.lower("email"))).alias("v"))
    groups = connected_components(edge.distinct()).select(F.col("node").alias("u"), "component")
    tagged = human.withColumn("u", F.xxhash64(F.concat(F.lit("n:"), F.lower("name")))).join(groups, "u")
    names = tagged.groupBy("component", "name").agg(F.count("*").alias("k"))
    best = names.groupBy("component").agg(F.min(F.struct((-F.col("k")).alias("k"), "name")).alias("b"))
    totals = tagged.groupBy("component").agg(F.count("*").alias("commits"), F.countDistinct(F.lower("email")).alias("emails"), F.countDistinct("repo").alias("repos"))
    return totals.join(best, "component").select(F.col("b.name").alias("name"), "commits", "emails", "repos")
