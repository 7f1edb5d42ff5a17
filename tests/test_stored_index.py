import random

import pytest

from tessera.operators import search
from tessera.operators.index import build_postings, doc_lengths
from tessera.operators.stored_index import SearchIndex
from tessera.runtime import new_path

WORDS = [f"word{i}" for i in range(60)] + ["Éclair", "naïve", "x_y"]


def drawers(spark, n=300):
    r = random.Random(9)
    rows = [(f"d{i:03}", r.choice(["w1", "w2"]), r.choice(["r1", "r2"]), r.choice(["", None, "the of", " ".join(["hot"] * r.randint(0, 3) + r.choices(WORDS, k=r.randint(1, 40)))]), r.choice([None, "", "/f/a", "/f/b", "/f/c"]), i) for i in range(n)]
    return spark.createDataFrame(rows, "id string, wing string, room string, content string, source_file string, chunk_index long")


@pytest.fixture(scope="module")
def both(spark):
    d = drawers(spark).cache()
    return d, build_postings(d), SearchIndex.build(d, new_path(spark, "test-index"), folders=16)


def rows(df):
    return [(r.id, r.wing, r.room, r.source_file, r.chunk_index, round(r.relevance, 9)) for r in df.collect()]


@pytest.mark.parametrize("query", ["hot word1", "word3 word3 hot éclair", "NAÏVE x_y", "word7", "absent", "hot " + " ".join(WORDS), "the of a"])
@pytest.mark.parametrize("where", [{}, {"wing": "w1"}, {"wing": "w2", "room": "r1"}, {"people": ["Word5 hot"]}])
def test_search_is_that_of_plain_postings(both, query, where):
    d, postings, index = both
    assert rows(index.search(query, 7, **where)) == rows(search.bm25_search(postings, d, query, 7, **where))


def test_a_search_reads_the_folders_of_its_words(both):
    _, _, index = both
    plan = index.search("hot word1", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [folder" in plan and "In(word" in plan


def test_neighbours_files_and_contents(both):
    d, postings, index = both
    found = index.search("hot word1 word2", 6)
    old = search.bm25_search(postings, d, "hot word1 word2", 6)
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    assert key(index.neighbours(found, 2), "anchor", "id", "chunk_index", "content") == key(search.neighbours(d, old, 2), "anchor", "id", "chunk_index", "content")
    files = {r.source_file for r in old.collect() if r.source_file}
    assert key(index.files_of(found), "id") == sorted(((r.id,) for r in d.collect() if r.source_file in files), key=repr)
    assert [(r.id, r.content) for r in index.contents_of(found).collect()] == [(r.id, r.content) for r in old.collect()]
    assert "dynamicpruning" in index.neighbours(found, 2)._jdf.queryExecution().executedPlan().toString()


def test_lengths_duplicates_and_empty_tables(spark, both):
    d, postings, index = both
    assert sorted(map(tuple, index.doc_lengths().collect())) == sorted(map(tuple, doc_lengths(postings).collect()))
    content = d.filter("length(content) > 100").first().content
    assert [r.id for r in index.check_duplicate(content).collect()] == [r.id for r in search.check_duplicate(postings, d, content).collect()] != []
    empty = SearchIndex.build(d.limit(0), new_path(spark, "test-index"))
    assert empty.search("hot", 5).collect() == [] and empty.neighbours(empty.search("hot", 5), 1).collect() == []
