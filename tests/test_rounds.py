"""Greedy deletion against the walk from pair to pair, and facts as of many times against each time alone."""

import random

import pytest

from tessera.operators import dedup, kg


def walk(pairs, sizes, most):
    """sizes: {id: (file, length)}; the ids that go, file by file."""
    by = {}
    for i, (file, length) in sizes.items():
        by.setdefault(file, []).append((-length, i))
    gone = set()
    for ids in by.values():
        order = [i for _, i in sorted(ids)]
        at, n = {i: k for k, i in enumerate(order)}, len(order)
        mine = sorted((min(at[a], at[b]), max(at[a], at[b])) for a, b in pairs if a in at and b in at)
        for i, j in mine:
            if most is not None and i * n - i * (i + 1) // 2 + j - i - 1 >= most:
                continue
            a, b = order[i], order[j]
            if a not in gone and b not in gone:
                gone.add(a if sizes[a][1] <= sizes[b][1] else b)
    return gone


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("most", [10_000, None, 40])
def test_rounds_delete_what_the_walk_deletes(spark, seed, most):
    r = random.Random(seed)
    sizes = {f"d{i:03}": (f"f{r.randint(0, 2)}", r.randint(1, 3 + 30 * (seed % 2))) for i in range(60)}
    ids = sorted(sizes)
    pairs = {(a, b) for a in ids for b in ids if a < b and sizes[a][0] == sizes[b][0] and r.random() < (0.05, 0.3, 0.9)[seed % 3]}
    p = spark.createDataFrame([(sizes[a][0], *(r.choice([(a, b), (b, a)]))) for a, b in pairs], "source_file string, a string, b string")
    s = spark.createDataFrame([(i, f, n) for i, (f, n) in sizes.items()], "id string, source_file string, length int")
    got = [tuple(x) for x in dedup.greedy(p, s, most).collect()]
    assert {i for _, i in got} == walk(pairs, sizes, most) and len(got) == len(set(got)) and all(sizes[i][0] == f for f, i in got)


def test_no_pairs_and_a_chain(spark):
    s = spark.createDataFrame([(f"c{i}", "f", 9 - i) for i in range(9)], "id string, source_file string, length int")
    none = spark.createDataFrame([], "source_file string, a string, b string")
    assert dedup.greedy(none, s).collect() == [] and dedup.greedy(none, s).columns == ["source_file", "id"]
    chain = [("f", f"c{i}", f"c{i + 1}") for i in range(8)]
    got = {r.id for r in dedup.greedy(spark.createDataFrame(chain, "source_file string, a string, b string"), s).collect()}
    assert got == {"c1", "c3", "c5", "c7"}


def test_as_of_many(spark):
    r = random.Random(4)
    days = ["1850-01-01", "1899-12-31", "1900-01-01", "1999-12-31", "2024-02-28", "2024-02-29", "2024-03-01", "2024-03-01T12:00:00Z", "2100-01-01", "2200-05-05"]
    bound = lambda: r.choice([None, None, *days, f"2024-{r.randint(1, 12):02}-{r.randint(1, 28):02}", "not a day"])
    facts = [(f"t{i}", r.choice("ab"), "p", r.choice("xy"), bound(), bound()) for i in range(150)]
    t = spark.createDataFrame(facts, "id string, subject string, predicate string, object string, valid_from string, valid_to string").cache()
    times = [*days, "2024-06-15", "2024-03-01T12:00:00+00:00"]
    rows = [(i, e, x) for i, (e, x) in enumerate((e, x) for e in "abz" for x in times)] + [(900, None, "2024-01-01"), (901, "a", None), (0, "a", times[0])]
    asked = spark.createDataFrame(rows, "n int, entity string, at string")
    got = sorted((x.n, x.id) for x in kg.as_of_many(t, asked).collect())
    want = sorted((n, x.id) for n, e, when in rows if e and when for x in t.filter(kg.valid_at(when)).filter(t.subject == e).collect())
    assert got == want and len(got) > 100
    back = kg.as_of_many(t, spark.createDataFrame([(1, "x", "2024-06-15")], "n int, entity string, at string"), "incoming")
    assert sorted(x.id for x in back.collect()) == sorted(x.id for x in t.filter(kg.valid_at("2024-06-15")).filter("object = 'x'").collect())
    with pytest.raises(ValueError):
        kg.as_of_many(t, asked, "both")
