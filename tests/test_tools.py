import pytest
from pyspark.sql import functions as F

from tessera.operators import diary, export, projects, registry
from tessera.operators.store import Store
from tessera.runtime import new_path
from tessera.sources import adapter, split
from tessera.tools import TOOLS, Tools, count, name


@pytest.fixture
def tools(spark):
    return Tools(Store(spark, new_path(spark, "tools")))


def test_all_tools_are_known(tools):
    assert len(TOOLS) == 32
    with pytest.raises(KeyError):
        tools.call("nothing")


def test_drawers_round_trip(tools):
    assert tools.call("add_drawer", wing="proj", room="backend", text="rust programming language is fast and safe", source_file="/x/main.rs") == 1
    assert tools.call("add_drawer", wing="proj", room="backend", text="rust programming language is fast and safe") == 0
    tools.call("add_drawer", wing="web", room="backend", text="react programming framework with components")
    found = tools.call("search", query="rust programming").collect()
    assert found[0].content.startswith("rust") and found[0].relevance > 0
    assert tools.call("search", query="the and for").count() == 0
    assert [r.n for r in tools.call("list_rooms").collect()] == [2] and tools.call("list_wings").count() == 2
    ident = found[0].id
    assert tools.call("get_drawer", drawer_id=ident).first().source_name == "main.rs"
    assert tools.call("update_drawer", drawer_id=ident, text="go is simple").count() == 0
    assert tools.call("search", query="rust").count() == 0 and tools.call("search", query="simple").count() == 1
    assert tools.call("list_drawers").count() == 2 and tools.call("reconnect") == 2
    tools.call("delete_drawer", drawer_id=tools.call("search", query="react").first().id)
    assert tools.call("status").first().drawers == 1 and tools.call("get_taxonomy").count() == 1
    assert tools.call("find_tunnels").count() == 0 and tools.call("graph_stats").first().rooms == 1
    assert [r.room for r in tools.call("traverse", start_room="backend").collect()] == ["backend"]


def test_facts(tools):
    assert tools.call("kg_add", subject="Alice", predicate="works at", object="Acme", valid_from="2024-01-01") == 1
    assert tools.call("kg_add", subject="Alice", predicate="works at", object="Acme") == 0
    row = tools.call("kg_query", entity="Alice").first()
    assert (row.subject, row.predicate, row.object, row.current) == ("Alice", "works_at", "Acme", True)
    tools.call("kg_invalidate", subject="Alice", predicate="works at", object="Acme", ended="2024-06-01")
    assert tools.call("kg_timeline", entity="Alice").first().valid_to == "2024-06-01" and tools.call("kg_stats").first().expired == 1
    tools.call("confirm_entity", entity="alice", kind="person")
    assert tools.call("research_entity", entity="ALICE").first().type == "person"
    with pytest.raises(ValueError):
        tools.call("kg_add", subject="a", predicate="p", object="b", confidence=1.5)


def test_links_and_diary(tools):
    tools.call("create_tunnel", source_wing="My App", source_room="api", target_wing="web", target_room="ui", text="shared")
    tools.call("create_tunnel", source_wing="web", source_room="ui", target_wing="my-app", target_room="api", text="again")
    link = tools.call("list_tunnels").collect()
    assert len(link) == 1 and link[0].label == "again"
    assert [(r.direction, r.wing) for r in tools.call("follow_tunnels", wing="my-app", room="api").collect()] == [("incoming", "web")]
    tools.call("delete_tunnel", tunnel=link[0].id)
    assert tools.call("list_tunnels").count() == 0
    assert tools.call("diary_write", agent="Ada", entry="today was good") == 1
    assert [r.content for r in tools.call("diary_read", agent="Ada").collect()] == ["today was good"]
    assert tools.call("hook_settings", silent_save=False, other=True)["silent_save"] is False


def test_argument_checks():
    assert name(" a b-c ") == "a b-c" and [count(x, 5) for x in ("7", 7.0, "x", -1, None, 500, 1.5)] == [7, 7, 5, 5, 5, 100, 5]
    for bad in ("", "../x", "a/b", "-a", "é", "a" * 129):
        with pytest.raises(ValueError):
            name(bad)


def test_split(spark):
    text = "junk\nClaude Code v1\n⏺ 9:05 AM Monday, March 4, 2024\n> cd somewhere\n> Fix the parser, please!\nanswer\nClaude Code v1\nCtrl+E to see previous messages\nClaude Code v2\nhello"
    got = split.sessions(spark.createDataFrame([("/x/mega.txt", text)], "path string, content string")).orderBy("session").collect()
    assert [r.name for r in got] == ["mega_2024-03-04_905AM_Fix-the-parser-please.txt", "mega_part02_session.txt"]
    assert got[1].content == "Claude Code v2\nhello"


def test_diary_files(spark):
    files = spark.createDataFrame([("/d/2024-01-02.md", 10, 5.0, "# D\n## A\nx\n## B\ny"), ("/d/2024-01-03-x.md", 10, 5.0, "## C\nz"), ("/d/notes.md", 1, 1.0, "## N\nn")], "path string, bytes long, mtime double, content string")
    empty = spark.createDataFrame([], "path string, hash string, bytes long, mtime double, entries int")
    first = diary.decisions(files, empty)
    rows = diary.entries(first, "w", "ada")
    assert rows.count() == 4 and len({r.id for r in rows.collect()}) == 4
    state = diary.new_state(first, empty)
    assert {r.decision for r in diary.decisions(files, state).collect()} == {"unchanged"}
    changed = files.withColumn("content", F.when(F.col("path").contains("-02"), "## A\nx").otherwise(F.col("content")))
    second = diary.decisions(changed, state)
    assert {r.path[-5:]: r.decision for r in second.collect()} == {"02.md": "rebuild", "-x.md": "unchanged", "es.md": "unchanged"}
    assert diary.stale(rows, second, diary.entries(second, "w", "ada")).count() == 2
    legacy = state.withColumn("hash", F.lit(None).cast("string")).withColumn("mtime", F.lit(1.0)).withColumn("entries", F.lit(1))
    assert diary.entries(diary.decisions(files, legacy), "w", "ada").count() == 2


def test_registry(spark):
    people = spark.createDataFrame([("Grace", "Grace", 0.9, "user"), ("Grace", "Gracie", 0.9, "user"), ("Will", "Will", 0.8, "user")], "name string, alias string, confidence double, source string")
    of = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    cache = spark.createDataFrame([("Paris", "place", 0.7, True), ("Rome", "place", 0.7, False)], "word string, kind string, confidence double, confirmed boolean")
    words = spark.createDataFrame([("gracie", ""), ("Will", "so will more of it"), ("Will", "Will said so with Will"), ("atlas", ""), ("Paris", ""), ("Rome", "")], "word string, context string")
    got = {(r.word, r.context): (r.kind, r.name) for r in registry.lookup(words, people, of("name", "Atlas"), cache, of("word", "will")).collect()}
    assert got == {("gracie", ""): ("person", "Grace"), ("Will", "so will more of it"): ("concept", "Will"), ("Will", "Will said so with Will"): ("person", "Will"), ("atlas", ""): ("project", "Atlas"), ("Paris", ""): ("place", "Paris"), ("Rome", ""): ("unknown", "Rome")}
    assert sorted(r.name for r in registry.people_in(of("query", "what did Gracie say", "willing"), people).collect()) == ["Grace"]
    known = lambda *v: spark.createDataFrame(list(v), "category string, name string")
    assert sorted(map(tuple, registry.merge_known(known(("p", "Ada")), known(("p", "ADA"), ("p", "Bob"))).collect())) == [("p", "Ada"), ("p", "Bob")]


def test_projects_and_export(spark):
    commits = spark.createDataFrame([("Me Myself", "m@x", "a")] * 3 + [("Other One", "o@x", "a"), ("Other One", "o@x", "b")], "name string, email string, repo string")
    assert [(r.name, r.mine, r.own, r.total) for r in projects.projects(commits, "Me Myself").collect()] == [("a", True, 3, 4), ("b", False, 0, 1)]
    row = spark.range(1).select(projects.signal(F.lit(1), F.lit(2)).alias("s"), projects.person_confidence(F.lit(5), F.lit(3)).alias("c"), projects.looks_like_name(F.lit("Ada de Lovelace")).alias("n"), projects.looks_like_name(F.lit("ada")).alias("m")).first()
    assert tuple(row) == ("1 commit across 2 repos", 0.99, True, False)
    sessions = spark.createDataFrame([("/p/-Users-me-app/1.jsonl", 1, '{"cwd":"/home/me/old"}'), ("/p/-Users-me-app/2.jsonl", 2, '{"cwd":"/home/me/new/"}'), ("/p/-x-slug/1.jsonl", 1, "{}")], "path string, mtime long, content string")
    assert {r.folder: r.project for r in projects.session_projects(sessions).collect()} == {"-Users-me-app": "new", "-x-slug": "slug"}
    d = spark.createDataFrame([("1", "w/x", "r", "text"), ("2", "w/x", "r", "")], "id string, wing string, room string, content string").withColumn("filed_at", F.lit("2024-01-01").cast("timestamp"))
    rows = export.markdown_rows(d).orderBy("at").collect()
    assert [r.file for r in rows] == ["w_x/r.md"] * 2 and rows[1].text == "### 2024-01-01 00:00:00\n\ntext\n\n---\n"
    assert [r.line for r in export.index_rows(d).collect()] == ["- [r](w_x/r.md)"]
    path = new_path(spark, "md")
    export.write_markdown(d, path)
    assert spark.read.text(path).filter("value = 'text'").count() == 1


class Lines(adapter.Adapter):
    label = "lines"

    def parts(self):
        return [1, 2]

    def records(self, part):
        yield (f"file{part}", 0, f"text {part}", {"n": str(part)})
        yield (f"file{part}", 1, "", {"n": "x"})


def test_adapters(spark):
    known = adapter.Registry(spark)
    known.add(Lines)
    with pytest.raises(ValueError):
        known.add(Lines)
    with pytest.raises(KeyError):
        known.resolve("other")
    assert known.resolve() == "filesystem" and known.resolve(None, "lines") == "lines"
    rows = known.read("lines")
    assert rows.count() == 4 and adapter.conforming(rows, {"n": "int"}, ["n"]).count() == 2
    assert adapter.is_filed(rows, "file1", 1) and not adapter.is_filed(rows, "file3", 0) and adapter.count_filed(rows, "file2") == 2


def test_facts_and_entities_move_together(tools, monkeypatch):
    from tessera.operators.store import Store

    tools.kg_add("Ann", "knows", "Bea")
    before = (tools.store.read("triples").count(), tools.store.read("entities").count())

    def lost(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(Store, "_move", lost)
        with pytest.raises(OSError):
            tools.kg_add("Cid", "knows", "Dan")
    assert (tools.store.read("triples").count(), tools.store.read("entities").count()) == before
    assert tools.kg_add("Cid", "knows", "Dan") == 1 and tools.store.read("entities").count() == before[1] + 2
    assert tools.store.version("triples") == tools.store.version("entities")
