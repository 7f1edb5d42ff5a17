"""Ignore files at every level of a tree of paths.

The lines of an ignore file hold for what lies below its folder.  For a file or
folder the last matching line of the deepest ignore file above it decides, and
what lies in an ignored folder is ignored whatever stands there.  Paths meet the
rules of the folders above them by equality of the folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: the deepest level that is scanned.
DEPTH = 64
#: Stand for the three places of a double star while single ones are written.
_FRONT, _INNER, _REST = "\x01", "\x02", "\x03"


def _parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def above(path: Column) -> Column:
    """The folders above a path from the top, which is the empty text; not the path itself."""
    parts = _parts(path)
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _pattern(body: Column) -> Column:
    """The regular expression of a line without its marks, for a path below the line's folder."""
    anchored = F.contains(body, F.lit("/"))
    s = F.ltrim(body, F.lit("/"))
    for old, new in (
        (r"\[!", "[^"),
        (r"\\([A-Za-z0-9])", "$1"),
        (r"(?<!\\)([.+$(){}|])", r"\\$1"),
        (r"^(?:\*\*/)+", _FRONT),
        (r"/(?:\*\*/)+", _INNER),
        (r"/\*\*$", _REST),
        (r"(?<!\\)\*+", "[^/]*"),
        (r"(?<!\\)\?", "[^/]"),
        (_FRONT, "(?:.*/)?"),
        (_INNER, "/(?:.*/)?"),
        (_REST, "/.+"),
    ):
        s = F.regexp_replace(s, old, new)
    return F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), s, F.lit("$"))


def rules(ignore_files: DataFrame) -> DataFrame:
    """(folder, depth, line, keep, folders_only, pattern) of the lines of ``ignore_files`` (folder, content).

    ``folder`` is relative to the top, which is the empty text.  Empty lines and
    comments are no rules; a null content has none.  White space at the end of a
    line doesn't count, and a mark after a backslash is a plain letter.
    """
    lines = ignore_files.select(F.array_join(_parts(F.col("folder")), "/").alias("folder"), F.posexplode(F.split("content", r"\r?\n")).alias("line", "raw"))
    text = F.rtrim(F.col("raw"))
    keep = F.startswith(text, F.lit("!"))
    body = F.when(keep, F.substring(text, 2, 1 << 30)).otherwise(text)
    bare = F.rtrim(body, F.lit("/"))
    rows = lines.filter((text != "") & ~F.startswith(text, F.lit("#")) & (bare != ""))
    return rows.select("folder", F.size(_parts(F.col("folder"))).alias("depth"), "line", keep.alias("keep"), F.endswith(body, F.lit("/")).alias("folders_only"), _pattern(bare).alias("pattern"))


def ignored(paths: DataFrame, lines: DataFrame) -> DataFrame:
    """(path) of the files of ``paths`` (path, relative to the top) that ``lines``, made by ``rules``, leave out.

    Repeated paths count once; null and empty ones are nowhere.  Every folder is
    judged once, however many files it holds.
    """
    files = paths.select("path").distinct().filter("path <> ''")
    folders = files.select(F.explode(above(F.col("path"))).alias("entry")).filter("entry <> ''").distinct()
    entries = folders.withColumn("folder_itself", F.lit(True)).unionAll(files.select("path", F.lit(False)))
    met = entries.withColumn("folder", F.explode(above(F.col("entry")))).join(lines, "folder").filter(F.col("folder_itself") | ~F.col("folders_only"))
    below = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.substr("entry", F.length("folder") + 2))
    last = met.filter(F.regexp_like(below, F.col("pattern"))).groupBy("entry").agg(F.max_by("keep", F.struct("depth", "line")).alias("keep"))
    out = last.filter(~F.col("keep")).select("entry")
    chain = files.select("path", F.explode(F.concat(above(F.col("path")), F.array("path"))).alias("entry"))
    return chain.join(out, "entry", "left_semi").select("path").distinct()


def kept(paths: DataFrame, ignore_files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The rows of ``paths`` (path, ...) that no ignore file leaves out and that lie at most ``depth`` folders deep."""
    near = paths.filter(F.size(_parts(F.col("path"))) <= depth + 1)
    return near.join(ignored(near, rules(ignore_files)), "path", "left_anti")
