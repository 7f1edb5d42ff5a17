"""Greedy deletion looks at all pairs of a file, however many there are."""

import inspect

from tessera.operators import dedup
from tessera.plans import graph_queries


def test_pairs_beyond_ten_thousand_are_looked_at(spark):
    sizes = spark.range(201).selectExpr("format_string('d%03d', id) id", "'f' source_file", "cast(300 - id as int) length")
    pairs = spark.createDataFrame([("f", f"d{i:03}", f"d{i + 1:03}") for i in (0, 198)], "source_file string, a string, b string")
    assert {r.id for r in dedup.greedy(pairs, sizes).collect()} == {"d001", "d199"}


def test_the_query_has_no_cut():
    assert "10000" not in graph_queries.ORACLE_SQL["dedup_greedy"]
    assert inspect.signature(dedup.greedy).parameters["most"].default is None


def test_low_similarity_writes_no_index(spark, monkeypatch):
    def index(*_):
        raise AssertionError("the search index is written")

    monkeypatch.setattr(graph_queries.M, "search_index", index)
    assert graph_queries.dedup_greedy_low(spark, "/root/testdata/sf0.001").columns == ["source_file", "id"]
