"""Project and conversation files as rows."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.functions.text import trimmed
from tessera.sources import ignore

#: Folders and files that are skipped, and endings that are read.
SKIP_DIRS = (
    ".git node_modules __pycache__ .venv venv vendor env dist build .next coverage target .terraform .ruff_cache .mypy_cache .pytest_cache "
    ".cache .tox .nox .idea .vscode .ipynb_checkpoints .eggs htmlcov"
).split()
SKIP_FILES = ".gitignore entities.json package-lock.json pnpm-lock.yaml yarn.lock Cargo.lock".split()
CODE = tuple(
    "txt md py js ts jsx tsx json jsonl yaml yml html css java go rs rb sh csv sql toml c cpp h hpp swift kt scala lua r php pl zig nim ex exs "
    "erl hs ml".split()
)
CHATS = ("txt", "md", "json", "jsonl")
LEAST_BYTES = 50


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether lines of a ``.gitignore`` leave a relative path out; the last match decides."""
    out = F.lit(False)
    for line in patterns:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, folder = line.startswith("!"), line.endswith("/")
        body = line.lstrip("!").rstrip("/")
        anchored = "/" in body
        glob = fnmatch.translate(body.lstrip("/")).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace("**", "*")
        glob = glob if "*" not in body else glob.replace(".*", "[^/]*")
        pattern = ("^" if anchored else "(?:^|/)") + glob + ("/" if folder else "(?:/|$)")
        out = F.when(path.rlike(pattern), not keep).otherwise(out)
    return out


def scan(spark: SparkSession, root: str, endings: tuple[str, ...] = CODE, patterns: list[str] = [], most_bytes: int = 500 << 20, forced: list[str] = [], nested: bool = True) -> DataFrame:
    """(path, relative, mtime, bytes, content) of the files below a folder.

    Skipped folders, files and endings are left out, as are ignored paths unless
    they are ``forced``.  ``patterns`` hold at the top; with ``nested`` the ignore
    files of all folders hold, too, and nothing deeper than ``ignore.DEPTH`` is
    listed.  The other conditions are on the listing, so files that those leave
    out aren't opened.  Bytes that aren't UTF-8 become U+FFFD.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    name = F.element_at(F.split(relative, "/"), -1)
    dirs = F.slice(F.split(relative, "/"), F.lit(1), F.size(F.split(relative, "/")) - 1)
    good = ~F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS])) & ~name.isin(*SKIP_FILES) & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*endings)
    left = ~ignored(relative, patterns) | relative.isin(*forced) if forced else ~ignored(relative, patterns)
    kept = files.filter((F.col("length") <= most_bytes) & good & left)
    if nested:
        listed = kept.select(relative.alias("path"))
        deepest = listed.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
        there = ignore.kept(listed, ignore_files(spark, root, min(deepest, ignore.DEPTH + 1)))
        there = there.unionAll(listed.filter(F.col("path").isin(*forced))) if forced else there
        kept = kept.join(there.select(F.col("path").alias("_there")).distinct(), relative == F.col("_there"), "left_semi")
    return kept.select("path", relative.alias("relative"), F.unix_micros("modificationTime").cast("double").alias("mtime"), F.col("length").alias("bytes"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def ignore_files(spark: SparkSession, root: str, levels: int) -> DataFrame:
    """(folder, content) of the ignore files in the first ``levels`` levels below a folder.

    Spark's file sources pass over names that begin with a point, so the driver
    reads these few files, found by one pattern a level.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(conf)
    base = fs.makeQualified(top).toString().rstrip("/")
    rows = []
    for level in range(levels):
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(base + "/*" * level + "/.gitignore")) or []:
            stream = fs.open(status.getPath())
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            rows.append((status.getPath().getParent().toString().removeprefix(base).strip("/"), text))
    return spark.createDataFrame(rows, "folder string, content string")


def readable(files: DataFrame) -> DataFrame:
    """Files whose trimmed text has 50 bytes or more."""
    return files.withColumn("content", trimmed(F.col("content"))).filter(F.octet_length("content") >= LEAST_BYTES)


def not_yet_read(files: DataFrame, freshness: DataFrame) -> DataFrame:
    """Files without rows that agree on their time of change."""
    known = freshness.filter("mtime is not null").select(F.col("source_file").alias("path"), "mtime")
    return files.join(known, ["path", "mtime"], "left_anti")


def cleaned(text: Column) -> Column:
    """Line ends as LF, without control characters."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def manifests(files: DataFrame) -> DataFrame:
    """(relative, name, kind) of project manifests, the shallowest first, then by kind."""
    c, base = F.col("content"), F.element_at(F.split("relative", "/"), -1)
    toml = F.regexp_extract(c, r'(?ms)^\[(?:project|package|tool\.poetry)\][^\[]*?^\s*name\s*=\s*"([^"]+)"', 1)
    found = F.when(base == "package.json", F.get_json_object(c, "$.name")).when(base.isin("pyproject.toml", "Cargo.toml"), toml).when(base == "go.mod", F.element_at(F.split(F.regexp_extract(c, r"(?m)^module\s+(\S+)", 1), "/"), -1))
    order = F.array_position(F.array(*[F.lit(x) for x in ("package.json", "pyproject.toml", "Cargo.toml", "go.mod")]), base)
    rows = files.select("relative", found.alias("name"), base.alias("kind"), F.size(F.split("relative", "/")).alias("depth"), order.alias("priority"))
    return rows.filter("name is not null and name <> ''").orderBy("depth", "priority", "relative")
