"""Names meet texts without anti joins, near names without broadcast keys, and contexts only where something can be."""

import itertools
import re

from tessera.operators import facts
from tessera.operators.entities import BESIDE
from tessera.operators.fuzzy import near_names
from tessera.operators.mentions import contexts
from tests.test_names import close


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_similar_names_meet_without_an_anti_join(spark):
    names = spark.createDataFrame([("Alice",), ("Alise",), ("Bob",)], "name string")
    found = facts.similar_names(spark.createDataFrame([(0, "alice"), (1, "alice alise")], "i int, text string"), names)
    assert "LeftAnti" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [(0, "Alice", "Alise", 1)]


def test_contexts_beside_a_pattern_only(spark):
    names = spark.createDataFrame([("Bob",)], "name string")
    texts = spark.createDataFrame([(0, "so Bob went on and on"), (1, "we were building  Bob"), (2, "Bob-core x"), (3, "a Bobv2 b"), (4, "Bob.py Bob: y")], "i int, text string")
    every = {tuple(r) for r in contexts(texts, names).collect()}
    some = {tuple(r) for r in contexts(texts, names, beside=BESIDE).collect()}
    assert some < every and {r[0] for r in every - some} == {0}


def test_near_names_broadcast_no_keys(spark, tmp_path):
    spark.range(900).selectExpr("format_string('Customer#%09d', id) name").write.parquet(f"{tmp_path}/names")
    found = near_names(spark.read.parquet(f"{tmp_path}/names"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) > 900 * 200
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    joins = re.findall(r"(\w+Join) \[(\w+)#", final)
    assert ("SortMergeJoin", "key") in joins and {kind for kind, by in joins if by == "key"} == {"SortMergeJoin"}
    assert not re.search(r"BroadcastHashJoin (?!\[n#)|BroadcastNestedLoopJoin", final)


def test_near_names_meet_once_where_edits_can_be_told_in_many_ways(spark):
    names = ["".join(p) for n in range(6) for p in itertools.product("ab", repeat=n)] + ["abé", "éab", "ABé", "z" * 23 + "ab", "z" * 22 + "ba", "z" * 24 + "ab", "z" * 24, "z" * 22 + "a"]
    got = [tuple(r) for r in near_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()]
    assert len(got) == len(set(got)) and set(got) == close(names)
