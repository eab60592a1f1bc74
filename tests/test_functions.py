import datetime as dt

import pytest
from pyspark.sql import functions as F

from harrow import schemas as S
from harrow.functions import dates, identity, matching, text, urls


def values(spark, inputs, make):
    """make(column) of each input, in order."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_urls(spark):
    given = ["HTTP://A.com:443/x/?b=2&utm_source=q&a=1#f", "https://a.com", " https://a.com/p/?Ref=1&k= ", "not a url", "", None, "https://a.com/x?q=a+b%20c&z=~*", "https://a.com/x?q=%zz", "https://x.com:80/"]
    assert values(spark, given, urls.normalize) == ["http://a.com/x?a=1&b=2", "https://a.com/", "https://a.com/p", "not a url", None, None, "https://a.com/x?q=a+b+c&z=~%2A", "https://a.com/x?q=%25zz", "https://x.com/"]
    assert values(spark, ["https://a.b.co.uk/x", "https://www.a.com:8080", "https://localhost/"], urls.root_domain) == ["b.co.uk", "a.com", "localhost"]
    assert values(spark, ["http://a.com", "ftp://a.com", "http://127.0.0.1/x", "http://10.1.1.1", "https://localhost:3", "http://172.20.0.1", "http://172.40.0.1"], urls.safe_to_fetch) == [True, False, False, False, False, False, True]
    assert values(spark, ["http://a.com", "http://a b.com", "ftp://a.com", "http://a", ""], urls.problem) == [None, "contains white space", "not http or https", "no dotted host", "empty"]


def test_identity(spark):
    job = lambda company, provider=None: lambda u: identity.job_id(u, F.lit(provider), F.lit(company))
    a, b = values(spark, ["https://t.wd1.myworkdayjobs.com/s/job/Data-Engineer_R246063", "https://t.wd1.myworkdayjobs.com/s/job/Data-Engineer-II_R246063"], job("Acme", "workday"))
    assert a == b == "acme:workday:R246063"
    got = values(spark, ["https://a.com/x?jobId=3402", "https://a.com/y/z?jobid=3402", "https://a.com/careers?params=ab", "https://a.com/job/12345", "https://a.com/p?utm_source=x", None], job("Acme, Inc."))
    assert got == ["acme:3402", "acme:3402", "acme:ab", "acme:12345", "acme:https://a.com/p", ""]
    assert values(spark, ["https://a.com/x?jobId=1"], job("Acme Corp")) != values(spark, ["https://a.com/x?jobId=1"], job("Contoso Ltd"))


def test_text(spark):
    assert values(spark, ["A &amp; B\n C", " ", None], text.clean) == ["A & B C", None, None]
    assert values(spark, ["Acme, Inc.", "The São Group", None], text.company_key) == ["acme", "são", ""]
    assert values(spark, ["=1+1", "@x", "ok", "\tx"], text.escape_formula) == ["'=1+1", "'@x", "ok", "'\tx"]
    assert values(spark, ["Remote/Hybrid", "Work from home", "Dallas"], text.infer_remote) == [False, True, None]
    assert values(spark, ["45", "1", "720", "3840"], text.humanize) == ["45 seconds", "1 second", "12 minutes", "1h 04m"]
    assert values(spark, ["Plano, USA", "Plano"], text.location_key) == ["plano", "plano"]
    df = spark.createDataFrame([("a", "A", None, "b")], "a string, b string, c string, d string")
    assert df.select(text.join_location("a", "b", "c", "d") if False else text.join_location(*map(F.col, "abcd"))).first()[0] == "a, b"


SCOPES = {
    "remote_us": ["Remote", "Remote, USA", "Remote - United States", "Anywhere in the US", "Work from home", "Remote - TX"],
    "remote_restricted": ["Remote - New York", "Remote (NY, NJ, CT)"],
    "remote_non_us": ["Remote (India)", "Remote - Bengaluru", "Remote (Pernambuco, Recife)", "Remote - Porto Alegre", "Remote, Maranhão", "Remote - Kraków", "Remote (Cebu)"],
    "hybrid": ["Hybrid - Dallas, TX"],
    "onsite": ["Dallas, TX", ""],
}


@pytest.mark.parametrize("want", SCOPES)
def test_remote_scope(spark, want):
    scope = lambda x: matching.remote_scope(x, F.lit("Data Engineer"), F.lit(None).cast("boolean"))
    assert set(values(spark, SCOPES[want], scope)) == {want}


def test_metro(spark):
    yes = ["Dallas, Texas", "Plano, Texas", "McKinney, Texas, USA", "Irving, TEXAS", *[f"{c}, TX" for c in matching.CITIES]]
    no = ["Arlington, VA", "Richardson, UT", "Frisco, CO", "Westlake Village, CA", "Allen, MI", "Denton, MD", "Arlington, Virginia, USA", "Westlake, Ohio", None]
    assert all(values(spark, yes, matching.in_metro)) and not any(values(spark, no, matching.in_metro))


def test_roles(spark):
    yes = ["Data Engineer", "Lead Data Engineer", "Snowflake Engineer", "ETL Developer", "Analytics Engineer", "Software Engineer, Data Engineering", "Senior Data Engineer - Vice President", "Data Engineer, VP"]
    no = ["Data Analyst", "Database Administrator", "Data Engineering Manager", "VP of Data Engineering", "Data Scientist - Vice President", "Software Engineer, Data Products", None, ""]
    assert all(values(spark, yes, matching.role)) and not any(values(spark, no, matching.role))


def test_fit(spark):
    f = lambda x: matching.fit(F.lit("Engineer"), x)
    full, none, blank = values(spark, ["Python, Spark and Snowflake on AWS.", None, " "], f)
    assert {"python", "spark", "snowflake", "aws"} <= set(full.matched) and full.score == 31
    assert none.score is None and blank.explanation == "no description available"


def now():
    return F.lit("2026-08-26 12:00:00").cast("timestamp")



def test_dates(spark):
    day = lambda x: dates.parse(x, now()).cast("date")
    none = ["Building 7", "Suite 200", "Req 12345", "Team 4", "$120,000 - $150,000", "5 openings", "Full-time", "Level 3", "1998-01-01", "2030-01-01", None, ""]
    assert values(spark, none, day) == [None] * len(none)
    d = dt.date
    given = {"2026-08-20": d(2026, 8, 20), "August 20, 2026": d(2026, 8, 20), "Posted 3 Days Ago": d(2026, 8, 23), "Posted Today": d(2026, 8, 26), "Yesterday": d(2026, 8, 25), "20 Aug 2026": d(2026, 8, 20), "Posted 30+ Days Ago": d(2026, 7, 27), "1787745600000": d(2026, 8, 26), "2026-08-20T10:00:00Z": d(2026, 8, 20), "Posted 2 Weeks Ago": d(2026, 8, 12)}
    assert values(spark, list(given), day) == list(given.values())


def test_freshness(spark):
    status = lambda x: dates.freshness(x.cast("timestamp"), F.lit(None).cast("timestamp"), now())[0]
    got = values(spark, ["2026-08-26 11:00:00", "2026-08-19 12:00:00", "2026-08-19 11:59:00", None, "2026-08-28 12:00:00"], status)
    assert got == [S.WITHIN, S.WITHIN, S.OLDER, S.UNDATED, S.WITHIN]
