import random

from hypothesis import given, settings, strategies as st

from tessera.operators.components import connected_components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_path_star_and_cycle(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3)]
    edges += [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute([(u, v) for u, v in edges if u is not None and u != v])


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
def test_random(spark, edges):
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])
