import pytest

from tessera.functions.text import canonical_time
from tessera.operators import graph, kg
from tessera.sources import files

T = "id string, subject string, predicate string, object string, valid_from string, valid_to string"


def facts(spark, *rows):
    return spark.createDataFrame([(f"t{i}", *r) for i, r in enumerate(rows)], T)


def named(spark, *names):
    return spark.createDataFrame([(n.lower(), n) for n in names], "id string, name string")


def test_facts_both_ways(spark):
    t, e = facts(spark, ("alice", "knows", "bob", "2024-01-01", None)), named(spark, "Alice", "Bob")
    assert [(r.subject, r.object, r.direction) for r in kg.facts(t, e, "Alice").collect()] == [("Alice", "Bob", "outgoing")]
    assert [(r.subject, r.object, r.direction) for r in kg.facts(t, e, "Bob").collect()] == [("Alice", "Bob", "incoming")]
    with pytest.raises(ValueError):
        kg.facts(t, e, "Bob", "sideways")


def test_as_of_widens_dates(spark):
    t = facts(spark, ("a", "p", "b", "2024-01-01", "2024-01-31"), ("a", "p", "c", "2024-01-31T12:00:00Z", None), ("a", "p", "d", None, "2023-12-31"))
    at = lambda day: sorted(r.object for r in t.filter(kg.valid_at(day)).collect())
    assert at("2024-01-31") == ["b"] and at("2024-01-31T13:00:00Z") == ["b", "c"] and at("2024-02-01") == ["c"] and at("2023-12-31") == ["d"]


def test_invalidate_and_add(spark):
    t, e = facts(spark, ("carol", "works_at", "oldco", "2024-01-15", None)), named(spark, "Carol", "OldCo")
    done = kg.invalidate(t, "Carol", "works at", "OldCo", "2024-06-01")
    assert [(r.valid_to, r.current) for r in kg.timeline(done, e, "Carol").collect()] == [("2024-06-01", False)]
    assert kg.invalidate(t, "Carol", "works at", "OldCo", "2023-01-01").first().valid_to is None
    new = spark.createDataFrame([("Carol", "Works At", "OldCo", None, None, 1.0), ("Dan", "knows", "O'Neil", "2025-06-01", "2025-01-01", 1.0), ("Dan", "knows", "O'Neil", None, None, float("nan")), ("Dan", "knows", "O'Neil", None, None, 0.5), ("Dan", "knows", "O'Neil", None, None, 0.9)], "subject string, predicate string, object string, valid_from string, valid_to string, confidence double")
    assert [(r.subject, r.predicate, r.object) for r in kg.add_facts(t, new).collect()] == [("dan", "knows", "oneil")]
    assert sorted(r.id for r in kg.new_entities(e, kg.add_facts(t, new)).collect()) == ["dan", "oneil"]


def test_times():
    assert canonical_time("2026-05-15T12:30:45+00:00") == "2026-05-15T12:30:45Z"
    for bad in ("2024-02-30", "2024-1-1", "yesterday", "2024-01-01T00:00:00+02:00"):
        with pytest.raises(ValueError):
            canonical_time(bad)


def test_room_graph(spark):
    d = spark.createDataFrame([("g1", "proj_a", "backend"), ("g2", "proj_a", "frontend"), ("g3", "proj_b", "backend"), ("g4", "proj_b", "database"), ("g5", "proj_b", "general")], "id string, wing string, room string")
    nodes = graph.room_nodes(d)
    assert nodes.count() == 3
    assert [(r.room, r.wing_a, r.wing_b) for r in graph.room_edges(nodes).collect()] == [("backend", "proj_a", "proj_b")]
    found = {r.room: (r.hop, r.via) for r in graph.traverse(nodes, "frontend", 2).collect()}
    assert found == {"frontend": (0, None), "backend": (1, ["proj_a"]), "database": (2, ["proj_b"])}
    assert graph.traverse(nodes, "nowhere", 2).count() == 0 and graph.traverse(nodes, "frontend", 1).count() == 2
    assert [r.room for r in graph.tunnels(nodes, "proj-a").collect()] == ["backend"]


def test_topic_tunnels(spark):
    t = spark.createDataFrame([("My App", "Rust", 0), ("my-app", "rust", 1), ("Web", "RUST ", 0), ("Web", "css", 1), ("Ops", "Css", 0)], "wing string, topic string, position int")
    one = {(r.wing_a, r.wing_b, r.room) for r in graph.topic_tunnels(t, 1).collect()}
    assert one == {("my_app", "web", "topic:Rust"), ("ops", "web", "topic:Css")} and graph.topic_tunnels(t, 2).count() == 0


def test_file_scan(spark, tmp_path):
    for name, text in {"a.py": "x" * 60, "b.log": "x" * 60, "node_modules/c.py": "x" * 60, "out/d.md": "y" * 60, "short.md": "tiny", "pkg/Cargo.toml": '[package]\nname = "crate_x"\n' + "#" * 60}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    found = files.scan(spark, str(tmp_path), patterns=["out/", "# note"])
    assert sorted(r.relative for r in found.collect()) == ["a.py", "pkg/Cargo.toml", "short.md"]
    assert sorted(r.relative for r in files.readable(files.scan(spark, str(tmp_path), patterns=["out/"], forced=["out/d.md"])).collect()) == ["a.py", "out/d.md", "pkg/Cargo.toml"]
    assert [(r.name, r.kind) for r in files.manifests(found).collect()] == [("crate_x", "Cargo.toml")]
