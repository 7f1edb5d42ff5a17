"""The store's tools by name.

Each tool takes checked arguments and returns a DataFrame over a ``Store``, or
changes it.  ``call`` finds one by name; unknown names and bad arguments are
errors.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tessera.functions.text import content_id, tunnel_id
from tessera.operators import browse, facts, graph, kg, search
from tessera.operators.store import Store

#: The longest name, fact value, label and content.
NAME, VALUE, LABEL, CONTENT = 128, 128, 255, 100_000


def name(value: str, what: str = "name") -> str:
    """A name of wings and rooms: ASCII letters, digits and ``_ .'-``, the first a letter or digit."""
    v = value.strip()
    if not v or len(v.encode()) > NAME or ".." in v or not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_ .'\-]*", v):
        raise ValueError(f"{what}: {value!r}")
    return v


def value(v: str, what: str = "value") -> str:
    """A fact value: any text without path parts."""
    v = v.strip()
    if not v or len(v) > VALUE or ".." in v or re.search(r"[/\\\x00]", v):
        raise ValueError(f"{what}: {v!r}")
    return v


def label(v: str) -> str:
    v = v.strip()
    if not v or len(v) > LABEL:
        raise ValueError(f"label: {v!r}")
    return v


def content(v: str) -> str:
    if not v.strip() or len(v) > CONTENT or "\x00" in v:
        raise ValueError("content is empty, too long or holds a null character")
    return v.strip()


def count(v: Any, default: int, most: int = 100) -> int:
    """A positive whole number, also as a float or text; anything else is the default."""
    try:
        f = float(v)
        return min(most, int(f)) if f > 0 and f == int(f) else default
    except (TypeError, ValueError, OverflowError):
        return default


class Tools:
    """All tools over one store."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.settings = {"silent_save": True, "desktop_toast": False}

    def call(self, tool: str, **args: Any) -> Any:
        """The result of a tool by name."""
        if tool not in TOOLS:
            raise KeyError(f"unknown tool {tool!r}")
        return getattr(self, tool)(**args)

    def _t(self, table: str) -> DataFrame:
        return self.store.read(table)

    def status(self) -> DataFrame:
        return browse.statistics(self._t("drawers"), self._t("entities"), self._t("triples"))

    def list_wings(self) -> DataFrame:
        return self._t("drawers").groupBy("wing").agg(F.count("*").alias("n"))

    def list_rooms(self, wing: str | None = None) -> DataFrame:
        return browse.where(self._t("drawers"), wing=wing).groupBy("room").agg(F.count("*").alias("n"))

    def get_taxonomy(self) -> DataFrame:
        return browse.taxonomy(self._t("drawers"))

    def get_line_format(self) -> DataFrame:
        return self.spark.createDataFrame([('ENTITIES|topics|"key sentence"|moods|FLAGS',)], "format string")

    def search(self, query: str, wing: str | None = None, room: str | None = None, limit: Any = 5) -> DataFrame:
        clean = self.spark.createDataFrame([(query,)], "q string").select(search.sanitized(F.col("q"))["query"]).first()[0]
        found = search.bm25_search(self._t("drawer_words"), self._t("drawers"), clean, count(limit, 5), wing and name(wing), room and name(room))
        words = search.query_tokens(clean)
        return search.boosted(found, search.closet_boosts(found, self._t("compressed"), words)) if words else found

    def check_duplicate(self, text: str) -> DataFrame:
        return search.check_duplicate(self._t("drawer_words"), self._t("drawers"), text)

    def add_drawer(self, wing: str, room: str, text: str, source_file: str | None = None, added_by: str = "tool") -> int:
        row = [(name(wing, "wing"), name(room, "room"), content(text), source_file, added_by, "mcp")]
        return self.store.add_contents(self.spark.createDataFrame(row, "wing string, room string, content string, source_file string, added_by string, ingest_mode string").withColumn("filed_at", F.current_timestamp()))

    def delete_drawer(self, drawer_id: str) -> None:
        self.store.delete_drawers(self.spark.createDataFrame([(drawer_id,)], "id string"))

    def get_drawer(self, drawer_id: str) -> DataFrame:
        return search.with_source_name(self._t("drawers").filter(F.col("id") == drawer_id))

    def list_drawers(self, wing: str | None = None, room: str | None = None, limit: Any = 20, offset: int = 0) -> DataFrame:
        return browse.page(self._t("drawers"), count(limit, 20), offset, wing=wing, room=room)

    def update_drawer(self, drawer_id: str, wing: str | None = None, room: str | None = None, text: str | None = None) -> DataFrame:
        return self.store.update_drawers(self.spark.createDataFrame([(drawer_id, wing and name(wing), room and name(room), text and content(text))], "id string, wing string, room string, content string"))

    def kg_query(self, entity: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
        return kg.facts(self._t("triples"), self._t("entities"), value(entity), direction, as_of)

    def kg_add(self, subject: str, predicate: str, object: str, valid_from: str | None = None, valid_to: str | None = None, confidence: float = 1.0) -> int:
        row = [(value(subject), name(predicate, "predicate"), value(object), valid_from and kg.canonical_time(valid_from), valid_to and kg.canonical_time(valid_to), kg.check_confidence(float(confidence)))]
        new = self.spark.createDataFrame(row, "subject string, predicate string, object string, valid_from string, valid_to string, confidence double")
        base = self.store.version("triples")
        old, entities = (self.store.read(t, base) for t in ("triples", "entities"))
        rows = kg.add_facts(old, new)
        shown = {kg._id(x): x for x in (subject, object)}
        names = F.create_map(*[F.lit(x) for kv in shown.items() for x in kv])
        ends = kg.new_entities(entities, rows).withColumn("name", names[F.col("id")])
        added = rows.count()
        if added:
            self.store.append(base, triples=rows, entities=ends)
        return added

    def kg_invalidate(self, subject: str, predicate: str, object: str, ended: str) -> None:
        self.store.change("triples", lambda t: kg.invalidate(t, subject, predicate, object, ended))

    def kg_timeline(self, entity: str | None = None) -> DataFrame:
        return kg.timeline(self._t("triples"), self._t("entities"), entity)

    def kg_stats(self) -> DataFrame:
        return kg.statistics(self._t("triples"), self._t("entities"))

    def traverse(self, start_room: str, max_hops: Any = 2) -> DataFrame:
        found = graph.traverse(graph.room_nodes(self._t("drawers")), start_room, count(max_hops, 2, 10))
        return graph.shown(found, "hop", F.desc("n"), "room")

    def find_tunnels(self, wing_a: str | None = None, wing_b: str | None = None) -> DataFrame:
        return graph.shown(graph.tunnels(graph.room_nodes(self._t("drawers")), wing_a, wing_b), F.desc("n"), "room")

    def graph_stats(self) -> DataFrame:
        return graph.statistics(graph.room_nodes(self._t("drawers")))

    def create_tunnel(self, source_wing: str, source_room: str, target_wing: str, target_room: str, text: str = "link", kind: str = "explicit") -> None:
        if kind not in ("explicit", "topic"):
            raise ValueError(f"kind: {kind!r}")
        norm = lambda w: name(w, "wing").lower().replace(" ", "_").replace("-", "_")
        row = self.spark.createDataFrame([(norm(source_wing), source_room, norm(target_wing), target_room, label(text), kind)], "source_wing string, source_room string, target_wing string, target_room string, label string, kind string")
        row = row.withColumn("id", tunnel_id(F.col("source_wing"), F.col("source_room"), F.col("target_wing"), F.col("target_room"))).withColumn("created_at", F.current_timestamp())
        self.store.change("explicit_tunnels", lambda t: graph.upsert_tunnels(t, row))

    def list_tunnels(self, wing: str | None = None) -> DataFrame:
        t = self._t("explicit_tunnels")
        t = t if wing is None else t.filter((F.col("source_wing") == wing) | (F.col("target_wing") == wing))
        return t.orderBy(F.desc("created_at"), "id")

    def delete_tunnel(self, tunnel: str) -> None:
        self.store.change("explicit_tunnels", lambda t: t.filter(F.col("id") != tunnel))

    def follow_tunnels(self, wing: str, room: str) -> DataFrame:
        t = self._t("explicit_tunnels")
        links = t.select("id", F.col("source_wing").alias("wing_a"), F.col("source_room").alias("room_a"), F.col("target_wing").alias("wing_b"), F.col("target_room").alias("room_b"), "label")
        return graph.follow(links, wing, room)

    def diary_write(self, agent: str, entry: str, topic: str = "general", wing: str | None = None) -> int:
        row = [(name(wing or f"wing_{agent.lower()}", "wing"), "diary", content(entry), name(agent, "agent"), "diary", topic)]
        df = self.spark.createDataFrame(row, "wing string, room string, content string, added_by string, ingest_mode string, extract_mode string").withColumn("filed_at", F.current_timestamp())
        return self.store.add_drawers(df.withColumn("id", content_id(F.col("wing"), F.col("room"), F.concat_ws("\u001f", "added_by", F.col("filed_at").cast("string"), "content"))))

    def diary_read(self, agent: str, last: Any = 10, wing: str | None = None) -> DataFrame:
        return browse.diary(self._t("drawers"), agent, count(last, 10), wing)

    def hook_settings(self, **changes: bool) -> dict[str, bool]:
        self.settings |= {k: bool(v) for k, v in changes.items() if k in self.settings}
        return dict(self.settings)

    def memories_filed_away(self) -> DataFrame:
        return self._t("drawers").orderBy(F.desc("filed_at"), "id").limit(1)

    def reconnect(self) -> int:
        self.spark.catalog.clearCache()
        return self._t("drawers").count()

    def check_facts(self, text: str, today: str) -> DataFrame:
        rows = self.spark.createDataFrame([(0, text)], "i int, text string")
        return facts.issues(facts.claims(rows), self._t("triples"), self._t("entities"), today)

    def research_entity(self, entity: str) -> DataFrame:
        return self._t("entities").filter(F.lower("name") == entity.lower())

    def confirm_entity(self, entity: str, kind: str) -> None:
        self.store.change("entities", lambda t: t.withColumn("type", F.when(F.lower("name") == entity.lower(), kind).otherwise(F.col("type"))))


#: The names of the tools.
TOOLS = tuple(n for n, f in vars(Tools).items() if callable(f) and not n.startswith("_") and n != "call")
