"""Projects and people from commits and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def person_confidence(commits: Column, repos: Column) -> Column:
    """How sure it is that an author is a person who matters."""
    return F.when((commits >= 100) | (repos >= 3), 0.99).when(commits >= 20, 0.85).otherwise(0.65)


def signal(commits: Column, repos: Column) -> Column:
    """The evidence in words."""
    s = lambda n: F.when(n == 1, "").otherwise("s")
    return F.concat(commits.cast("string"), F.lit(" commit"), s(commits), F.lit(" across "), repos.cast("string"), F.lit(" repo"), s(repos))


def looks_like_name(name: Column) -> Column:
    """Two words or more, the first and the last with a capital."""
    return name.rlike(r"^\s*\p{Lu}\S*(\s+\S+)*\s+\p{Lu}\S*\s*$")


def projects(commits: DataFrame, me: str) -> DataFrame:
    """Repositories of ``commits`` (name, email, repo): mine first, then by commits.

    A repository is mine if I am among its five busiest authors, wrote a tenth
    of its commits, or twenty.
    """
    by = commits.groupBy("repo", "name").agg(F.count("*").alias("k"))
    rank = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("k"), "name"))
    facts = by.withColumn("rank", rank).groupBy("repo").agg(F.sum("k").alias("total"), F.sum(F.when(F.col("name") == me, F.col("k")).otherwise(0)).alias("own"), F.min(F.when(F.col("name") == me, F.col("rank"))).alias("rank"))
    mine = (F.col("own") > 0) & ((F.col("rank") <= 5) | (F.col("own") * 10 >= F.col("total")) | (F.col("own") >= 20))
    return facts.select(F.col("repo").alias("name"), mine.alias("mine"), "own", "total").orderBy(F.desc("mine"), F.desc("own"), F.desc("total"), "name")


def session_projects(files: DataFrame) -> DataFrame:
    """(folder, project): the last part of the newest session's working folder, else of the folder's name.

    ``files`` is (path, mtime, content) of session files, one folder a project.
    """
    folder = F.element_at(F.split("path", "/"), -2)
    cwd = F.regexp_extract("content", r'"cwd"\s*:\s*"([^"]+)"', 1)
    best = files.select(folder.alias("folder"), "mtime", "path", F.nullif(cwd, F.lit("")).alias("cwd")).groupBy("folder").agg(F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.struct("mtime", "path"))).alias("cwd"))
    return best.select("folder", F.coalesce(F.element_at(F.split(F.regexp_replace("cwd", "/+$", ""), "/"), -1), F.element_at(F.split("folder", "-"), -1)).alias("project"))
