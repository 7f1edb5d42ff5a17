import pytest
from pyspark.sql import functions as F

from tessera.operators import browse, dedup, index, mining
from tessera.operators.store import Store
from tessera.runtime import new_path


def contents(spark, *rows):
    return spark.createDataFrame(list(rows), "wing string, room string, content string")


@pytest.fixture
def store(spark):
    return Store(spark, new_path(spark, "store"))


def test_add_is_idempotent_and_indexed(spark, store):
    rows = contents(spark, ("a", "r", "rust is fast"), ("a", "r", "python is slow"))
    assert store.read("drawers").count() == 0
    assert store.add_contents(rows) == 2 and store.add_contents(rows) == 0
    words = store.read("drawer_words")
    assert {r.word for r in words.collect()} == {"rust", "fast", "python", "slow"}
    assert index.integrity(store.read("drawers"), words).count() == 0


def test_update_changes_ids_and_refuses_collisions(spark, store):
    store.add_contents(contents(spark, ("a", "r", "one thing"), ("a", "r", "two things")))
    ids = {r.content: r.id for r in store.read("drawers").collect()}
    patch = spark.createDataFrame([(ids["one thing"], None, None, "two things")], "id string, wing string, room string, content string")
    assert [r.id for r in store.update_drawers(patch).collect()] == [ids["one thing"]]
    patch = spark.createDataFrame([(ids["one thing"], "b", None, "three stones")], "id string, wing string, room string, content string")
    assert store.update_drawers(patch).count() == 0
    now = {r.content: (r.id, r.wing) for r in store.read("drawers").collect()}
    assert set(now) == {"two things", "three stones"} and now["three stones"][1] == "b" and now["three stones"][0] not in ids.values()
    assert {r.word for r in store.read("drawer_words").collect()} == {"two", "things", "three", "stones"}


def test_one_of_two_writers_wins(spark, store):
    base = store.version("entities")
    rows = spark.createDataFrame([("x", "X", "t")], "id string, name string, type string")
    store.write("entities", rows, base)
    with pytest.raises(Exception):
        store.write("entities", rows.limit(0), base)
    assert store.read("entities").count() == 1 and store.read("entities", 0).count() == 0


def test_delete_prune_and_rebuild(spark, store):
    store.add_contents(contents(spark, ("a", "r", "alpha beta"), ("a", "r", "gamma delta")))
    ids = [r.id for r in store.read("drawers").orderBy("content").collect()]
    buckets = spark.createDataFrame([(ids[0], "missing"), (ids[1], "kept")], "id string, bucket string")
    assert {r.bucket: r.n for r in store.prune(buckets).collect()} == {"missing": 1, "kept": 1}
    assert [r.id for r in store.read("drawers").collect()] == ids[1:]
    store.write("drawer_words", store.read("drawer_words").limit(0))
    store.rebuild_index()
    assert store.read("drawer_words").count() == 2


def test_cascade(spark):
    ids = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    triples = spark.createDataFrame([("t1", "d1"), ("t2", None), ("t3", "d2")], "id string, source_drawer_id string")
    tunnels = spark.createDataFrame([("u1", "d1", None), ("u2", "d2", "d1"), ("u3", None, "d2")], "id string, source_drawer_id string, target_drawer_id string")
    out = dedup.cascade(ids("id", "d1"), ids("id", "d1", "d2"), ids("id", "d1", "d2"), ids("id", "d1"), triples, tunnels)
    assert {k: v.count() for k, v in out.items()} == {"drawers": 1, "postings": 1, "closets": 0, "triples": 3, "tunnels": 1}
    assert {r.id: r.source_drawer_id for r in out["triples"].collect()} == {"t1": None, "t2": None, "t3": "d2"}


def test_greedy_dedup(spark):
    sizes = spark.createDataFrame([("a", "f", 200), ("b", "f", 100), ("c", "f", 100), ("d", "f", 100)], "id string, source_file string, length int")
    pairs = lambda *p: spark.createDataFrame([("f", x, y) for x, y in p], "source_file string, a string, b string")
    gone = lambda *p: sorted(r.id for r in dedup.greedy(pairs(*p), sizes).collect())
    assert gone(("b", "a")) == ["b"] and gone(("c", "b")) == ["b"]
    assert gone(("a", "b"), ("b", "c"), ("c", "d")) == ["b", "c"]
    assert [r.id for r in dedup.greedy(pairs(("c", "d")), sizes, most=5).collect()] == []


def test_rebuild_guard():
    assert index.rebuild_is_safe(5, 5) and not index.rebuild_is_safe(4, 5)
    assert index.rebuild_is_safe(9_999, None) and not index.rebuild_is_safe(10_000, None)


def test_story_is_cut_by_bytes(spark):
    rows = [(f"{i:02}", "w", "r", "é" * 190, f"/x/{i}.md") for i in range(15)]
    d = spark.createDataFrame(rows, "id string, wing string, room string, content string, source_file string").withColumn("filed_at", F.lit("2024-01-01").cast("timestamp"))
    lines = [r.line for r in browse.essential_story(d).orderBy("position").collect()]
    assert lines[0] == "\n[r]" and lines[-1] == "  ... (more in L3 search)"
    assert sum(len(x.encode()) for x in lines[:-1]) <= 3200


def test_no_update_is_lost(spark, store):
    one, two = contents(spark, ("a", "r", "first text")), contents(spark, ("a", "r", "second text"))
    base = store.version("drawers")
    assert store.add_contents(one) == 1
    late = two.withColumn("id", F.lit("x"))
    with pytest.raises(Exception):
        store.add_drawers(late, base)
    assert [r.content for r in store.read("drawers").collect()] == ["first text"]
    assert store.add_drawers(late) == 1 and store.rows("drawers") == 2
    words = store.read("drawer_words")
    assert index.integrity(store.read("drawers"), words).count() == 0 and words.count() == 4


def test_appends_are_folded_and_rebuilds_guarded(spark, store, monkeypatch):
    monkeypatch.setattr("tessera.operators.store.FOLDERS", 3)
    for i in range(5):
        store.add_contents(contents(spark, ("a", "r", f"text number{i}")))
    state = store._state("drawers", store.version("drawers"))
    assert len(state["drawers"]["folders"]) <= 3 and state["drawers"]["rows"] == 5 == store.read("drawers").count()
    gone = state["drawers"] | {"rows": 1000}
    store._move("drawers", store.version("drawers"), {"drawers": gone})
    with pytest.raises(ValueError):
        store.rebuild_index()


def test_mining(spark, store, tmp_path):
    (tmp_path / "backend").mkdir()
    (tmp_path / "backend" / "a.md").write_text("The server reads requests. " * 60)
    (tmp_path / "b.txt").write_bytes(b"caf\xe9 and more text that is long enough to be read as a file " * 2)
    (tmp_path / "skip.bin").write_bytes(b"x" * 500)
    rooms = [("backend", ["server"]), ("docs", [])]
    n = mining.mine(store, f"file://{tmp_path}", "proj", rooms)
    got = store.read("drawers").collect()
    assert n == len(got) >= 3 and {r.room for r in got if r.source_file.endswith("a.md")} == {"backend"}
    assert any("caf\ufffd" in r.content for r in got) and not any(r.source_file.endswith("bin") for r in got)
    assert mining.mine(store, f"file://{tmp_path}", "proj", rooms) == 0
    (tmp_path / "b.txt").write_text("now another text altogether, long enough to be read as a file")
    assert mining.mine(store, f"file://{tmp_path}", "proj", rooms) == 1
    texts = [r.content for r in store.read("drawers").collect() if r.source_file.endswith("b.txt")]
    assert len(texts) == 1 and "another" in texts[0]


def test_greedy_without_a_limit_of_pairs(spark):
    pairs = spark.createDataFrame([("f", "a", "b")], "source_file string, a string, b string")
    sizes = spark.createDataFrame([(f"z{i:05}", "f", 9) for i in range(200)] + [("a", "f", 2), ("b", "f", 1)], "id string, source_file string, length int")
    assert dedup.greedy(pairs, sizes, 100).count() == 0 and [r.id for r in dedup.greedy(pairs, sizes, None).collect()] == ["b"]


def test_mining_a_changed_file_is_one_version(spark, store, tmp_path, monkeypatch):
    rooms = [("docs", []), ("general", [])]
    (tmp_path / "a.md").write_text("# One\n\n" + "the first text of the file with many words in it " * 40)
    (tmp_path / "b.md").write_text("# Two\n\n" + "another file that stays as it is in every run " * 40)
    root = f"file://{tmp_path}"
    assert mining.mine(store, root, "proj", rooms) > 0
    state = lambda: (sorted((r.id, r.content) for r in store.read("drawers").collect()), sorted(map(tuple, store.read("drawer_words").collect())))
    before, version = state(), store.version("drawers")
    (tmp_path / "a.md").write_text("# One\n\n" + "quite different words stand here after the change " * 40)
    (tmp_path / "a.md").touch()

    def lost(*args):
        raise OSError("the job was lost before the pointer moved")

    with monkeypatch.context() as m:
        m.setattr(Store, "_move", lost)
        with pytest.raises(OSError):
            mining.mine(store, root, "proj", rooms)
    assert state() == before and store.version("drawers") == version
    assert mining.mine(store, root, "proj", rooms) > 0
    assert store.version("drawers") == version + 1
    texts = " ".join(c for _, c in state()[0])
    assert "quite different" in texts and "first text" not in texts and "another file" in texts
    words = {w for w, _, _ in state()[1]}
    assert "different" in words and "first" not in words


def test_mining_names_the_version_it_read(spark, store, tmp_path, monkeypatch):
    (tmp_path / "a.md").write_text("some words that are long enough to be kept as a drawer of their own in the store " * 3)
    real = mining.drawers_of

    def slow(*args):
        store.add_drawers(spark.createDataFrame([("late", "w", "r", "came between")], "id string, wing string, room string, content string"))
        return real(*args)

    monkeypatch.setattr(mining, "drawers_of", slow)
    with pytest.raises(Exception):
        mining.mine(store, f"file://{tmp_path}", "proj", [("docs", [])])
    assert [r.id for r in store.read("drawers").collect()] == ["late"]
