from tessera.operators import layers
from tessera.operators.stored_index import SearchIndex
from tessera.runtime import new_path

D = "id string, wing string, room string, content string, source_file string, chunk_index int, filed_at timestamp"
T = "id string, subject string, predicate string, object string, valid_from string, valid_to string, source_drawer_id string"


def tables(spark, content="short text", n=3, facts=4):
    rows = [(f"d{i}", "w" if i % 2 == 0 else "v", "r", content, f"/f/{i}.md", 0, None) for i in range(n)]
    t = [(f"t{i}", "ann", "knows", f"p{i}", None, None if i % 2 == 0 else "2020-01-01", "d0" if i < 2 else "d1") for i in range(facts)]
    e = [("ann", "Ann")] + [(f"p{i}", f"P{i}") for i in range(facts)]
    return spark.createDataFrame(rows, D), spark.createDataFrame(t, T), spark.createDataFrame(e, "id string, name string")


def lines(df):
    return [r.line for r in df.orderBy(*[c for c in ("part", "position") if c in df.columns]).collect()]


def test_story_with_facts(spark):
    d, t, e = tables(spark)
    assert lines(layers.wake_story(d, t, e)) == ["\n[r]", "  - short text  (0.md)", "  - short text  (1.md)", "  - short text  (2.md)", "\n[knowledge graph]", "  - Ann knows P0", "  - Ann knows P1", "  - Ann knows P2", "  - Ann knows P3"]
    assert lines(layers.wake_story(d, t.filter("object = 'p1'"), e, "w"))[-1] == "  - short text  (2.md)"  # an ended fact names no pair
    assert lines(layers.fact_lines(t, e, 0, d, "w"))[:2] == ["\n[knowledge graph]", "  - Ann knows P0"]
    assert lines(layers.fact_lines(t.filter("source_drawer_id = 'd1'"), e, 0, d, "w")) == [] and lines(layers.fact_lines(t.limit(0), e)) == []
    assert lines(layers.wake_story(d.limit(0), t, e)) == []
    assert layers.wake_up(" me \n", d, t, e).startswith("## L0 — IDENTITY\nme\n\n## L1 — ESSENTIAL STORY\n\n[r]\n") and "No memories yet." in layers.wake_up(None, d.limit(0), t, e)


def test_one_budget_for_both(spark):
    d, t, e = tables(spark, "x" * 190, 14, 60)
    got = lines(layers.wake_story(d, t, e))
    assert sum(len(x.encode()) for x in got) <= 3200 and "\n[knowledge graph]" in got and 1 < sum("knows" in x for x in got) < 60
    d, t, e = tables(spark, "x" * 400, 15, 4)
    got = lines(layers.wake_story(d, t, e))
    assert got[-1] == layers.CUT and not any("knows" in x for x in got)
    many = spark.createDataFrame([(f"t{i}", "ann", "knows", "p0", None, None, None) for i in range(2000)], T)
    assert sum(len(x.encode()) for x in lines(layers.fact_lines(many, e))) <= 3200


def test_deep_search(spark):
    rows = [(f"c{i}", "w", "r", f"chunk number{i}\nhas {'target ' * (i == 3)}words", "/f/a.md", i, None) for i in range(8)] + [("lone", "w", "r", "target target " + "y" * 400, None, 0, None)]
    index = SearchIndex.build(spark.createDataFrame(rows, D), new_path(spark, "layers-index"))
    got = lines(layers.deep_search(index, "target", 5))
    assert got[0].startswith("  [1] w/r (score=") and got[1].endswith("...") and got[2].startswith("  [2] w/r") and got[4] == "      src: /f/a.md" and len(got) == 5
    got = lines(layers.deep_search(index, "number3", 5))
    assert got[3] == "      nearby context:" and got[4:] == [f"        chunk {i}: chunk number{i} has words" for i in (1, 2, 4, 5)]
    assert lines(layers.deep_search(index, "absent", 5)) == []
