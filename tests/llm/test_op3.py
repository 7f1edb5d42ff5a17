import datetime

import duckdb

from pyspark.sql import functions as F

from tessera.llm import op3
from tessera.llm.url_lists import as_of, intervals

SF = "/root/testdata/sf0.01"


def test_all_pages_match_sql(spark):
    got = sorted(map(tuple, op3.op3_url_filter(spark, SF).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    want = sorted(con.sql(op3.ORACLE).fetchall(), key=str)
    assert got == want and 20 < sum(r[3] for r in got) < len(got) - 20
    assert any("," in (r[5] or "") for r in got) and any(r[6] != r[1] for r in got if r[3])


def test_intervals_and_edges(spark):
    entries = spark.createDataFrame([("a.com", "2024-01-10", "list", "x"), ("A.com", "2024-01-20", "delist", "x"), ("a.com", "2024-01-20", "delist", "x"), ("b.a.com", "2024-01-05", "list", "y"), (None, "2024-01-01", "list", "z"), ("c.com", None, "list", "z"), ("d.com", "2024-02-01", "list", "p"), ("d.com", "2024-02-01", "delist", "p")], "host string, day string, action string, category string").withColumn("day", F.col("day").cast("date"))
    found = intervals(entries)
    assert sorted((r.host, str(r.since), str(r.until)) for r in found.collect()) == [("a.com", "2024-01-10", "2024-01-20"), ("b.a.com", "2024-01-05", "9999-12-31"), ("d.com", "2024-02-01", "9999-12-31")]
    day = datetime.date
    rows = [(1, "http://A.com/x", day(2024, 1, 10)), (2, "http://a.com", day(2024, 1, 20)), (3, "https://u:p@z.b.a.com:80/q", day(2024, 1, 15)), (4, None, day(2024, 1, 15)), (5, "http://a.com", None), (6, "not a url", day(2024, 1, 15)), (7, "http://xa.com/", day(2024, 1, 15)), (1, "http://A.com/x", day(2024, 1, 10)), (8, "http://" + "a." * 5000 + "a.com/", day(2024, 1, 15)), (9, "http://localhost/", day(2024, 1, 1))]
    captures = spark.createDataFrame(rows, "page_id long, url string, day date").selectExpr("*", "'old' as host", "1 as rule", "2 as extra", "3 as v", "4 as row", "'x' as of")
    got = as_of(captures, found)
    assert got.columns.count("host") == 1
    shown = sorted((r.page_id, r.blocked, r.rule, r.extra) for r in got.collect())
    assert shown == [(1, True, "a.com", 2), (1, True, "a.com", 2), (2, False, None, 2), (3, True, "b.a.com", 2), (4, False, None, 2), (5, False, None, 2), (6, False, None, 2), (7, False, None, 2), (8, True, "a.com", 2), (9, False, None, 2)]
    assert as_of(captures.limit(0), found).count() == 0 and not any(r.blocked for r in as_of(captures, found.limit(0)).collect())


def test_dots_at_the_end_of_a_host_do_not_evade_the_list(spark):
    found = intervals(spark.createDataFrame([("bad.com", "2024-01-01", "list", "x"), ("worse.org.", "2024-01-01", "list", "y")], "host string, day string, action string, category string").withColumn("day", F.col("day").cast("date")))
    urls = ["http://bad.com./x", "http://a.BAD.com..:80/", "http://worse.org/", "http://worse.org./", "http://./", "http://good.com./"]
    rows = spark.createDataFrame([(i, u, datetime.date(2024, 2, 1)) for i, u in enumerate(urls)], "page_id long, url string, day date")
    assert [(r.host, r.blocked) for r in as_of(rows, found).orderBy("page_id").collect()] == [("bad.com", True), ("a.bad.com", True), ("worse.org", True), ("worse.org", True), ("", False), ("good.com", False)]


def test_categories_labels_and_addresses(spark):
    list_ = [("x.com", "2024-01-01", "list", "spam"), ("x.com", "2024-02-01", "list", "malware"), ("x.com", "2024-03-01", "delist", "malware"), ("x.com", "2024-02-01", "list", None), ("zip", "2024-01-01", "list", "tld"), ("3.4", "2024-01-01", "list", "bad"), ("1.2.3.4", "2024-01-01", "list", "net"), ("[::1]", "2024-01-01", "list", "six")]
    found = intervals(spark.createDataFrame(list_, "host string, day string, action string, category string").withColumn("day", F.col("day").cast("date")))
    day = datetime.date(2024, 3, 10)
    urls = {1: ("http://x.com/", day), 2: ("http://x.com/", datetime.date(2024, 2, 10)), 3: ("http://a.b.zip/q", day), 4: ("http://zip", day), 5: ("http://1.2.3.4:80/", day), 6: ("http://2.2.3.4/", day), 7: ("http://[::1]:8080/", day), 8: ("http://azip/", day)}
    got = {r.page_id: (r.blocked, r.category, r.categories, r.rule) for r in as_of(spark.createDataFrame([(i, *x) for i, x in urls.items()], "page_id long, url string, day date"), found).collect()}
    # a null category has an interval too and comes first among those of one day
    assert got == {1: (True, None, "spam", "x.com"), 2: (True, None, "malware,spam", "x.com"), 3: (True, "tld", "tld", "zip"), 4: (True, "tld", "tld", "zip"), 5: (True, "net", "net", "1.2.3.4"), 6: (False, None, None, None), 7: (True, "six", "six", "[::1]"), 8: (False, None, None, None)}
