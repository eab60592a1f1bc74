import pytest
from pyspark.sql import functions as F

from harrow.functions import providers, text, urls
from harrow.operators import filters, walk

from .test_functions import values


def test_links_and_hosts(spark):
    assert values(spark, ["Apply", "JOIN US", "Search Jobs", "Data Engineer", "View all roles"], text.is_navigation) == [True, True, True, False, True]
    pairs = [("Data Engineer", "/j/1", True), ("Data Engineer", "#top", False), ("Data Engineer", "#/detail/1", True), ("Data Engineer", "mailto:x", False), ("Short", "/j", False), (None, "/j", False)]
    df = spark.createDataFrame(pairs, "t string, h string, want boolean")
    assert df.where(text.is_posting_link(F.col("t"), F.col("h")) != F.col("want")).count() == 0
    assert values(spark, ["https://t.wd1.myworkdayjobs.com/en-US/Site/job/Dallas/X_R1", "https://a.com/job/1", "https://t.myworkdayjobs.com/job/1"], urls.detail) == ["https://t.wd1.myworkdayjobs.com/wday/cxs/t/Site/job/Dallas/X_R1", None, None]
    assert values(spark, ["careers.acme.com", "acme.com"], urls.other_hosts) == [["acme.com", "www.acme.com"], ["www.acme.com"]]
    df = spark.createDataFrame([(["R1", "Dallas", "R0012-2"], "/job/x_R1")], "b array<string>, p string")
    assert df.select(text.place_of_bullets(F.col("b"), F.col("p"))).first()[0] == "Dallas"


def test_embedded(spark):
    page = '<a href="https://jobs.lever.co/acme&amp;x"></a><script src="https://x.icims.com/a/jquery.js"></script><a href="https://acme.icims.com/jobs/search?a=1&amp;b=2">'
    assert values(spark, [page], lambda h: providers.embedded(h, "lever")) == [["https://jobs.lever.co/acme"]]
    assert values(spark, [page], lambda h: providers.embedded(h, "icims")) == [["https://acme.icims.com/jobs/search?a=1&b=2"]]
    got = values(spark, [page, "x", "phApp.ddo"], lambda h: providers.resolve(F.lit("https://a.com"), h)["provider"])
    assert got == ["lever", "unknown", "phenom"]


def test_tables(spark):
    raw = spark.createDataFrame([(" Acme ", "u", None), ("nan", "u", "v"), (None, None, None)], "Company string, ATS string, Live string")
    assert [tuple(r) for r in filters.companies(raw, "Company", "ATS", "Live").collect()] == [("Acme", "u", None)]
    with pytest.raises(ValueError, match="Nope"):
        filters.companies(raw, "Nope", "ATS", "Live")
    t = spark.createDataFrame([("a", "FALSE", 0, None, "x"), ("b", "TRUE", 3, "kept", "y"), ("c", None, None, "", None)], "company string, status string, count int, suggestion string, ats_url string")
    c = spark.createDataFrame([("a", 2), ("b", 0)], "company string, jobs int")
    assert sorted((r.company, r.status, r["count"]) for r in filters.write_status(t, c).collect()) == [("a", "TRUE", 2), ("b", "FALSE", 0), ("c", None, None)]
    f = spark.createDataFrame([("a", "https://n"), ("b", "https://m"), ("c", None)], "company string, url string")
    assert sorted((r.company, r.suggestion, r.ats_url) for r in filters.suggest(t, f, True).collect()) == [("a", "https://n", "https://n"), ("b", "kept", "y"), ("c", "NOT FOUND", None)]
    names = spark.createDataFrame([("A ",)], "company string")
    assert [r.company for r in filters.company_named(t, names).collect()] == ["a"] and filters.company_contains(t, "B").count() == 1
    d = spark.createDataFrame([("Acme", "https://www.a.com/x/", None), ("Other", None, "http://a.com/x")], "company string, ats_url string, live_jobs_url string")
    assert sorted((r.same_name, r.same_url) for r in filters.duplicates(d, "acme", F.lit("https://a.com/x")).collect()) == [(False, True), (True, True)]
    need = spark.createDataFrame([("workday", "3 Locations", True), ("workday", None, True), ("workday", "Dallas", False), ("lever", None, False)], "p string, x string, want boolean")
    assert need.where(filters.needs_detail(F.col("p"), F.col("x")) != F.col("want")).count() == 0


def test_stale_pages_end_a_walk(spark):
    pages = [("s", k, [2 * k, 2 * k + 1], 9000, False, k in (1, 3, 4)) for k in range(8)]
    df = spark.createDataFrame(pages, "source string, page_no int, rows array<int>, total int, failed boolean, stale boolean")
    r = walk.walk(df).first()
    assert (r.stop_reason, r.pages, r.complete) == ("freshness_reached", 5, False)
