import hashlib
import random
import zlib

from tessera.llm.merkle import BLOCK, folded, height_of, manifest, visit
from tessera.llm.op11 import op11_merkle_manifest

SF = "/root/testdata/sf0.01"
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The root and, for each leaf, (left siblings, right siblings) of every level."""
    level, where, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, at in enumerate(where):
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            paths[leaf].append((run[: at % 3], run[at % 3 + 1 :]))
        level = [H("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        where = [w // 3 for w in where]
    return level[0], paths


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs = []
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0], leaf_of(r)))
        subs.append((own, *tree([leaf_of(r) for r in own])))
    root, over = tree([x[1] for x in subs])
    out = []
    for (own, sub, paths), top in zip(subs, over):
        for r, path in zip(own, paths):
            path = path + top
            bad = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                bad[4] = r[4].replace("\n", "")
            x = leaf_of(bad)
            for left, right in path:
                x = H("".join(left) + x + "".join(right))
            out.append((r[0], leaf_of(r), sub, root, H("".join(y for a, b in path for y in a + b)), x, x == root))
    return out


def plain(rows):
    return sorted(map(repr, rows))


def test_all_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in op11_merkle_manifest(spark, SF).select(*COLUMNS).collect()]
    assert plain(got) == plain(brute(rows))
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows_blocks_and_clashing_names(spark):
    r = random.Random(3)
    rows = [(r.choice([None, i, i, 7]), r.choice([None, "", "a", "é", "hot", "hot"]), r.choice([None, "", "de"]), r.choice([None, 3]), r.choice([None, "", "a\nb", "long\n" * r.randint(1, 500)])) for i in range(3 * BLOCK)]
    rows += [(i, "one block more", "x", 1, str(i)) for i in range(BLOCK * BLOCK // 100 + 1)] + [(5, "alone", None, 1, "t\n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").selectExpr("*", "1 as g", "2 as idx", "3 as digest", "4 as n", "5 as part")
    got = [tuple(x) for x in manifest(df).select(*COLUMNS).collect()]
    assert plain(got) == plain(brute(rows))


def test_few_rows(spark):
    schema = "doc_id long, source string, lang string, n_chars int, text string"
    for rows in ([], [(1, None, None, None, None)], [(1, "a", "x", 2, "q\n"), (2, "b", "x", 2, "q")], [(i, "s", "x", 1, "t") for i in (1, 1, 1, 1)], [(i, str(i), "x", 1, "t\n") for i in range(BLOCK + 2)]):
        got = [tuple(x) for x in manifest(spark.createDataFrame(rows, schema)).select(*COLUMNS).collect()]
        assert plain(got) == plain(brute(rows) if rows else [])


def test_walk_appends_siblings_while_unwinding():
    for n in (1, 2, 3, 4, 10, 28, 100):
        leaves = [H(str(i)) for i in range(n)]
        paths = [[] for _ in leaves]
        root = visit(leaves, 0, height_of(n), paths)
        want, sides = tree(leaves)
        assert root == want and all(folded(x, "".join(p)) == root for x, p in zip(leaves, paths))
        assert [["".join(a) + "." + "".join(b) + "/" for a, b in s] for s in sides] == paths
