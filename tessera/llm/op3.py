"""op3: every page against the URL lists of its fetch date.

``pages`` has no fetch date and there is no list; the query gives each page one
of the days of 2024, by its id, and lists the pages' hosts and the domains above
them under some categories for some days, by a hash of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.llm.tables import table
from tessera.llm.url_lists import ADDRESS, HOST, as_of, domains, host_of, intervals

#: The categories of the list.
CATEGORIES = ("gambling", "malware", "phishing", "spam")


def entries(pages: DataFrame) -> DataFrame:
    """Dated events (host, day, action, category) for the hosts of ``pages``.

    One in six pairs of a host and a category is listed, one in sixty of a
    domain of a single label, for 1 to 40 days; every second one comes back 90
    days later and stays.
    """
    rules = pages.select(F.explode(domains(host_of(F.col("url")))).alias("host")).filter("host <> ''").distinct()
    each = rules.select("host", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    drawn = F.conv(F.substring(F.md5(F.concat("host", F.lit("#"), "category")), 1, 7), 16, 10).cast("long")
    listed = each.withColumn("h", drawn).filter(F.col("h") % F.when(F.contains("host", F.lit(".")), 6).otherwise(60) == 0)

    def event(after: Column, action: str) -> Column:
        day = F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(F.col("h") / 60) % 300 + after).cast("int"))
        return F.struct(day.alias("day"), F.lit(action).alias("action"))

    once = [event(F.lit(0), "list"), event(1 + F.floor(F.col("h") / 7) % 40, "delist")]
    events = F.when(F.floor(F.col("h") / 3) % 2 == 0, F.array(*once, event(F.lit(90), "list"))).otherwise(F.array(*once))
    return listed.select("host", "category", F.explode(events).alias("e")).select("host", "e.day", "e.action", "category")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("day"))
    out = as_of(pages, intervals(entries(pages)))
    return out.select("page_id", "host", F.date_format("day", "yyyy-MM-dd").alias("day"), "blocked", "category", "categories", "rule", F.date_format("since", "yyyy-MM-dd").alias("since"))


_LIST = ", ".join(f"'{c}'" for c in CATEGORIES)
ORACLE = f"""
WITH p AS (
  SELECT page_id, lower(regexp_replace(regexp_extract(coalesce(url, ''), '{HOST}', 1), '\\.+$', '')) AS host,
         DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS day FROM pages
), s AS (
  SELECT DISTINCT host AS full_host, string_split(host, '.') AS l FROM p WHERE host <> ''
), d AS (
  SELECT full_host, CASE WHEN i = 1 THEN full_host ELSE array_to_string(l[i:], '.') END AS host
  FROM (SELECT full_host, l, unnest(range(1, CASE WHEN regexp_matches(full_host, '{ADDRESS}') THEN 2 ELSE len(l) + 1 END)) AS i FROM s)
), c AS (
  SELECT host, category, CAST('0x' || substr(md5(host || '#' || category), 1, 7) AS BIGINT) AS h
  FROM (SELECT DISTINCT host FROM d WHERE host <> '') CROSS JOIN (SELECT unnest([{_LIST}]) AS category)
), b AS (
  SELECT host, category, h, DATE '2024-01-01' + CAST((h // 60) % 300 AS INTEGER) AS day FROM c WHERE h % (CASE WHEN contains(host, '.') THEN 6 ELSE 60 END) = 0
), e AS (
  SELECT host, category, day, 'list' AS action FROM b
  UNION ALL SELECT host, category, day + CAST(1 + (h // 7) % 40 AS INTEGER), 'delist' FROM b
  UNION ALL SELECT host, category, day + 90, 'list' FROM b WHERE (h // 3) % 2 = 0
), i AS (
  SELECT host, category, action, day AS since, coalesce(lead(day) OVER (PARTITION BY host, category ORDER BY day), DATE '9999-12-31') AS until FROM e
), m AS (
  SELECT p.page_id, i.category, i.host AS rule, i.since,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(i.host) DESC, i.since DESC, i.category) AS k,
         array_to_string(list_sort(list_distinct(list(i.category) OVER (PARTITION BY p.page_id))), ',') AS categories
  FROM p JOIN d ON d.full_host = p.host JOIN i ON i.host = d.host AND i.action = 'list' AND i.since <= p.day AND p.day < i.until
)
SELECT p.page_id, p.host, strftime(p.day, '%Y-%m-%d') AS day, m.page_id IS NOT NULL AS blocked, m.category, m.categories, m.rule, strftime(m.since, '%Y-%m-%d') AS since
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""
