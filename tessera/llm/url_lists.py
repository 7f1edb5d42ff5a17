"""Filtering captures by dated URL lists, as of the time of each capture.

List entries are dated events for a host and a category: listed or delisted.
The events of a host and category become validity intervals; a capture is
blocked when an interval of its host, or of a domain above it, holds its date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.llm.small import small
from tessera.runtime import materialize

#: The host of a URL, a host without names above it, and the date of an open end, as fixed values.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)"
ADDRESS = r"^([0-9.]+|\[.*)$"
OPEN = "9999-12-31"
ADDED = ["host", "blocked", "category", "categories", "rule", "since"]


def host_of(url: Column) -> Column:
    """The host of a URL in small letters, without dots at its end; empty for null and for other texts."""
    return _plain(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def _plain(host: Column) -> Column:
    return F.lower(F.regexp_replace(host, r"\.+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """Intervals [since, until) of ``entries`` (host, day, action, category).

    ``action`` is ``list`` or ``delist``; each holds until the next event of the
    same host and category, a null category being one of its own.  A listing
    outweighs a delisting of the same day.  Dots at the end of a host don't count.  Rows with a null host or day play no
    part; repeated rows count once.
    """
    clean = entries.filter("host is not null and day is not null").groupBy(_plain(F.col("host")).alias("host"), "category", "day").agg(F.max("action").alias("action"))
    until = F.coalesce(F.lead("day").over(W.partitionBy("host", "category").orderBy("day")), F.lit(OPEN).cast("date"))
    return clean.select("host", F.col("day").alias("since"), until.alias("until"), "action", "category").filter("action = 'list'").drop("action")


def domains(host: Column) -> Column:
    """The host and the domains above it, down to one label; an address has none above it."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def as_of(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """Add host, blocked, category, categories, rule and since to ``captures`` (url, day).

    ``listed`` holds intervals (host, since, until, category).  ``categories``
    are those of all intervals that hold the day, joined by commas; of the
    intervals the one of the longest host gives the rest, then the latest, then
    the smallest category, null first.  Hosts and days are made distinct first,
    so a host of very many captures is looked up once a day; captures without a
    host or day are not blocked.  Columns of the added names are replaced; other
    columns and repeated rows stay.
    """
    kept = [c for c in captures.columns if c.lower() not in ADDED]
    known = captures.select(F.struct(*kept).alias("row"), host_of(F.col("url")).alias("host"))
    asked = known.select("host", F.col("row.day").alias("day")).filter("host <> '' and day is not null").distinct()
    steps = asked.select("host", "day", F.explode(domains(F.col("host"))).alias("rule"))
    rules = listed.select(F.col("host").alias("rule"), "since", "until", "category")
    hits = steps.join(rules, "rule").filter("since <= day and day < until")
    best = F.min(F.struct((-F.length("rule")).alias("a"), (-F.unix_date("since")).alias("b"), "category", "rule", "since"))
    all_ = F.array_join(F.array_sort(F.collect_set("category")), ",")
    verdicts = materialize(hits.groupBy("host", "day").agg(best.alias("v"), all_.alias("categories")), "url-verdicts")
    verdicts = small(verdicts.select(F.col("host").alias("of"), F.col("day").alias("on"), "v", "categories"), verdicts)
    joined = known.join(verdicts, (F.col("host") == F.col("of")) & (F.col("row.day") == F.col("on")), "left")
    return joined.select("row.*", "host", F.col("v").isNotNull().alias("blocked"), F.col("v.category").alias("category"), "categories", F.col("v.rule").alias("rule"), F.col("v.since").alias("since"))
