"""Terms are looked for where they can be."""

from tessera.functions.origin import corpus_origin


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_origin_looks_only_where_a_term_can_be(spark):
    d = spark.createDataFrame([("x", "plain words"), ("x", "See claude.MD and chatgpt"), ("y", "AI : hi\nUSER: ho a>>> user")], "corpus string, text string")
    found = corpus_origin(d)
    assert "contains(" in plan(found).lower()
    assert {r.corpus: (r.brands, r.turns) for r in found.collect()} == {"x": (3, 0), "y": (0, 3)}
