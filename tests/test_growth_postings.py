"""Postings move nothing."""

from tessera.operators.index import build_postings


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_counted_in_their_rows(spark):
    d = spark.createDataFrame([("a", "zeta eta zeta"), ("b", ""), ("c", None), ("d", "eta")], "id string, content string")
    assert "Aggregate" not in plan(build_postings(d))
    assert sorted(tuple(r) for r in build_postings(d).collect()) == [("eta", "a", 1), ("eta", "d", 1), ("zeta", "a", 2)]
    assert sorted(tuple(r) for r in build_postings(d.unionAll(d)).collect()) == [("eta", "a", 2), ("eta", "d", 2), ("zeta", "a", 4)]
