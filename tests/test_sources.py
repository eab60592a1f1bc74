import json

from pyspark.sql import functions as F

from harrow.sources import pages, vendors

LD = {"@graph": [{"@type": ["JobPosting"], "title": "Data Engineer", "datePosted": "2026-08-20", "jobLocation": [{"address": {}}, {"address": {"addressLocality": "Dallas", "addressRegion": "TX", "addressCountry": {"name": "US"}}}]}, {"x": {"@type": "JobPosting", "title": "nested"}}]}
NEXT = {"props": {"jobs": [{"jobTitle": "ETL Developer", "url": "/jobs/1"}, {"jobTitle": "ETL Developer", "url": "/jobs/1"}, {"title": "no address"}]}}
PAGE = f"""<html><script type="application/ld+json">{json.dumps(LD)}</script><script type="application/ld+json">{{bad</script>
<script id="__NEXT_DATA__" type="x">{json.dumps(NEXT)}</script><a class=c href="/jobs/7">Data &amp; more</a><a href="/jobs/7">again</a><a href="mailto:x/jobs/">mail</a><a href="/about">About</a></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://a.com/c", PAGE), (2, None, None)], "page_id long, url string, html string")
    r = pages.jsonld_jobs(df).collect()
    assert [(x.title, x.location, x.job_url) for x in r] == [("Data Engineer", "Dallas, TX, US", "https://a.com/c")]
    assert sorted(x.title for x in pages.jsonld_jobs(df, deep=True).collect()) == ["nested"]
    assert [(x.title, x.job_url) for x in pages.payload_jobs(df).collect()] == [("ETL Developer", "https://a.com/jobs/1")]
    assert [(x.title, x.job_url) for x in pages.job_links(df).collect()] == [("Data & more", "https://a.com/jobs/7")]


def test_totals_and_blocks(spark):
    df = spark.createDataFrame([("Showing 1 - 20 of 1,234 jobs", False), ("9 openings, total: 12", False), ("Access Denied", True), ("of 999999999", False)], "x string, b boolean")
    got = [(r.n, r.k) for r in df.select(pages.stated_total(F.col("x")).alias("n"), (pages.blocked(F.lit(None).cast("string"), F.col("x")) == F.col("b")).alias("k")).collect()]
    assert got == [(1234, True), (12, True), (None, True), (None, True)]


def test_vendor_mappings(spark):
    lever = json.dumps([{"text": "Data Engineer", "categories": {"location": "Remote", "commitment": "Full"}, "createdAt": 1787745600000, "hostedUrl": "https://l/1", "descriptionPlain": "", "description": "<p>x</p>"}, {"text": "", "hostedUrl": "https://l/2"}])
    wd = json.dumps({"jobPostings": [{"title": "ETL", "locationsText": "Dallas", "postedOn": "Posted Today", "externalPath": "/job/x_R1"}]})
    df = spark.createDataFrame([("a", "https://l", lever), ("a", "https://l", "{bad")], "company string, base string, body string")
    r = vendors.records(df, "lever").collect()
    assert [(x.title, x.location, x.date_text, x.job_url, x.employment_type, x.description, x.remote) for x in r] == [("Data Engineer", "Remote", "1787745600000", "https://l/1", "Full", "x", True)]
    df = spark.createDataFrame([("b", "https://w/site/", wd)], "company string, base string, body string")
    assert [(x.job_url, x.date_text) for x in vendors.records(df, "workday").collect()] == [("https://w/site/job/x_R1", "Posted Today")]


def test_markup():
    from harrow.sources import markup as M

    assert M.visible("<p>a<span class='x sr-only'>no<b>no</b></span><!-- c --><script>x</script> b &amp; c</p>") == "a b & c" and M.visible(None) == ""
    assert M.more("", 3) == (None, None) and M.more("<p>10 jobs</p>", 10) == (10, None)
    assert M.more("<p>Showing 1 - 10 of 1,234, 2,000,000 jobs posted</p>", 10) == (1234, "stated total")
    assert M.more("<a class=sr-only>Next</a><button aria-label='Next page'></button>", 50)[1] == "more button"
    assert M.more("<a href=/x>View all jobs</a>", 31)[1] is None
    assert M.careers_link("<a href='/careers'>x</a><a href=/b>Our careers</a><a href=/c>Jobs</a>", "https://a.com/") == "https://a.com/c"
    assert M.object_after("m = {\"a\": {\"b\": 1}} ; {", r"m\s*=\s*") == '{"a": {"b": 1}}' and M.object_after("m = {", r"m\s*=\s*") is None
    assert not M.is_careers_page("<a href='/jobs/1'>Engineer</a>") and M.is_careers_page("<a href='/jobs/1'>Engineer</a>" + " " * 2000)
    pages.links("<a href='/jobs/1'>" * 20000, "https://a.com")  # unclosed anchors take linear time


def test_vendor_fields(spark):
    def one(provider, row, **more):
        body = row if provider == "lever" else None
        path = vendors.MAPPINGS[provider]["rows"]
        body = [row] if path == "$" else {"jobs": [row], "opportunities": [row], "content": [row], "jobPostings": [row]}[path[2:]] if False else {path[2:]: [row]}
        df = spark.createDataFrame([("c", "https://h", json.dumps(body), more.get("site"), more.get("corp"))], "company string, base string, body string, site string, corp string")
        return vendors.records(df, provider).first()

    r = one("smartrecruiters", {"name": "T", "ref": "https://r", "location": {"city": "Plano", "region": "TX", "country": "us", "remote": True}})
    assert (r.location, r.remote) == ("Plano, TX, us", True)
    assert one("ukg", {"Title": "T", "Url": "https://r", "Locations": [{"LocalizedDescription": "A"}, {"LocalizedDescription": "B"}]}).location == "A, B"
    assert one("ukg", {"Title": "T", "Url": "https://r", "Locations": [{"Address": {"City": "Plano", "State": {"Code": "TX"}}}]}).location == "Plano, TX"
    assert one("amazon", {"title": "T", "job_path": "/x", "city": "Plano", "state": "TX", "country_code": "US"}).location == "Plano, TX, US"
    r = one("phenom", {"title": "T", "jobId": "9", "multi_location_array": [{"city": "A"}, "B"]})
    assert (r.location, r.job_url) == ("A | B", "https://h/job/9")
    assert one("workday", {"title": "T", "externalPath": "/job/x_R1", "bulletFields": ["R1", "Dallas"]}).location == "Dallas"
    assert one("paylocity", {"jobTitle": "T", "id": 7}).job_url == "https://h/recruiting/jobs/Details/7"


def test_payloads_without_bound(spark):
    """A thousand payloads of a page, and one of two million objects: every posting is kept."""
    post = lambda k: f'{{"title": "Job {k}", "url": "/j/{k}", "text": "{"x" * 220}"}}'
    many = "".join(f"<script>window.__STATE_{k}__ = {post(k)};</script>" for k in range(1000))
    large = '<script id="__NEXT_DATA__" type="application/json">{"a": [' + ",".join('{"n":1}' if k % 4000 else f'{{"title": "Big {k}", "url": "/b/{k}"}}' for k in range(2_000_000)) + "]}</script>"
    deep = '<script id="__NEXT_DATA__" type="application/json">' + '{"a":' * 200_000 + "1" + "}" * 200_000 + "</script>"
    df = spark.createDataFrame([(1, "https://h.example/", many), (2, "https://h.example/", large), (3, "https://h.example/", deep + many)], "page_id long, url string, html string")
    got = {r[0]: r[1] for r in pages.payload_jobs(df.repartition(3)).groupBy("page_id").count().collect()}
    assert got == {1: 1000, 2: 500, 3: 1000}
