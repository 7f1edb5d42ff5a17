"""Times meet few facts at once."""

import random

from tessera.operators import kg


def test_few_and_many_facts_of_an_entity(spark, monkeypatch):
    r = random.Random(6)
    day = lambda: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}"
    t = spark.createDataFrame([(f"t{i}", f"e{i % 7 if i < 40 else 0}", "p", "o", r.choice([None, day()]), r.choice([None, day()])) for i in range(80)], "id string, subject string, predicate string, object string, valid_from string, valid_to string")
    asked = spark.createDataFrame([(f"e{i % 8}", day()) for i in range(30)], "entity string, at string")
    runs = []
    for few in (0, 20, 1000):
        monkeypatch.setattr(kg, "FEW", few)
        runs.append(sorted(map(repr, kg.as_of_many(t, asked).collect())))
    assert runs[0] == runs[1] == runs[2] and runs[0]
