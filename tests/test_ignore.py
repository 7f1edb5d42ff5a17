import subprocess

import pytest

from tessera.sources import files, ignore

TREE = {
    "": "*.log\n!keep.log\n/made/\n# note\n\ndoc/**/x.txt\n\\#odd\nsp?ce.md  \n**/gen/\na/b/*.py\nz[!0-9].md\n",
    "src": "!*.log\n/tmp\nlib/**\n!lib/a.md\n",
    "src/deep": "*\n!*/\n!*.md\n",
    "other": "!/x.log\n*.txt\n",
}
PATHS = [
    "a.log", "keep.log", "made/a.md", "sub/made/a.md", "doc/x.txt", "doc/a/b/x.txt", "x.txt", "#odd", "space.md", "spAce.md", "gen/a.md", "q/gen/r/a.md", "a/b/c.py", "q/a/b/c.py",
    "src/a.log", "src/tmp/a.md", "src/x/tmp/a.md", "src/lib/a.md", "src/lib/b/c.md", "src/deep/a.py", "src/deep/a.md", "src/deep/er/b.md", "src/deep/er/b.log", "other/x.log", "other/y/x.log", "other/x.txt",
    "made.md", "zz.md", "z1.md", "za.md", "keep.log/inner.md", "a+b.md", "sub/keep.log", "sub/x.log",
]


def test_paths_are_ignored_as_git_ignores_them(spark, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    mine = [p for p in PATHS if p != "keep.log/inner.md"]
    for p in mine:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    for folder, text in TREE.items():
        (tmp_path / folder / ".gitignore").write_text(text)
    said = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", *mine], capture_output=True, text=True).stdout.split("\n")
    lines = ignore.rules(spark.createDataFrame(list(TREE.items()), "folder string, content string"))
    got = {r.path for r in ignore.ignored(spark.createDataFrame([(p,) for p in [*mine, mine[0]]], "path string"), lines).collect()}
    assert got == {s.strip('"') for s in said if s} and 10 < len(got) < len(mine)
    found = {r.relative for r in files.scan(spark, f"file://{tmp_path}", endings=("md", "log", "txt", "py")).select("relative").collect()}
    assert found == {p for p in mine if p not in got and p != "#odd"}
    assert "a.log" in {r.relative for r in files.scan(spark, f"file://{tmp_path}", endings=("log",), forced=["a.log"]).select("relative").collect()}


def test_edges(spark):
    lines = ignore.rules(spark.createDataFrame([("", None), ("/a/", "!\n/\n#x\n  \n*.md\r\n"), ("b", "")], "folder string, content string"))
    assert [(r.folder, r.pattern) for r in lines.collect()] == [("a", r"^(?:.*/)?[^/]*\.md$")]
    paths = spark.createDataFrame([("a/x.md", 1), ("x.md", 2), (None, 3), ("", 4), ("/".join("d" * 1 for _ in range(ignore.DEPTH + 1)) + "/x", 5)], "path string, n int")
    got = ignore.kept(paths, spark.createDataFrame([("a", "*.md")], "folder string, content string")).collect()
    assert sorted(r.n for r in got) in ([2, 3, 4], [2, 4], [2])
    assert ignore.ignored(paths, lines.limit(0)).count() == 0


def test_sample_for_detection(spark):
    from tessera.sources.sample import detection_sample

    rows = [("rich", f"p{i}.md", "é" * 40) for i in range(6)] + [("rich", "a.py", "code")] + [("poor", "z.txt", "prose"), ("poor", "b.rs", "x" * 500), ("poor", "a.go", None), ("poor", "c.bin", "no")] + [(None, None, "no path"), (None, "n.md", "null project"), (None, "n.md", "null project")]
    df = spark.createDataFrame(rows, "project string, path string, content string").selectExpr("*", "1 as place", "2 as kind")
    got = sorted(((r.project or "", r.place, r.path, len(r.content.encode())) for r in detection_sample(df, 4, 51, 120).collect()))
    assert got == [("", 1, "n.md", 12), ("", 2, "n.md", 12), ("poor", 1, "z.txt", 5), ("poor", 2, "a.go", 0), ("poor", 3, "b.rs", 51), ("rich", 1, "p0.md", 50), ("rich", 2, "p1.md", 50), ("rich", 3, "p2.md", 50)]
    assert detection_sample(df.limit(0)).count() == 0
