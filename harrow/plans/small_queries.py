"""Registered queries of small functions and filters: cases made from the rows' own keys and names, each
with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, providers, text, urls
from ..operators import filters, hints, merge
from ..sources import pages
from .queries import _t, query

def _k():
    return F.col("c_custkey")


def _customers(spark, d):
    return _t(spark, d, "customer").withColumn("k", _k().cast("string"))


def _case(*values):
    """The value whose place is the key's remainder; values are texts or columns."""
    out = [v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string") for v in values]
    return F.element_at(F.array(*out), (_k() % len(out) + 1).cast("int"))


def _made(*parts):
    """Texts and columns joined."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# ---------------------------------------------------------------- text


@query("select c_custkey, case c_custkey % 4 when 0 then 'A & B ' || c_name when 1 then c_name || ' é' when 2 then null else '<' || c_name end as cleaned from customer")
def clean_text(spark, d):
    c = _customers(spark, d)
    raw = _case(_made(" A &amp;  B\n", F.col("c_name")), _made(F.col("c_name"), "&nbsp;&eacute; "), " \t\n", _made("&lt;", F.col("c_name")))
    return c.select("c_custkey", text.clean(raw).alias("cleaned"))


@query("select c_custkey, case c_custkey % 4 when 0 then 'plano tx' when 1 then lower(c_mktsegment) when 2 then '' else 'austin' end as key from customer")
def location_key(spark, d):
    return _customers(spark, d).select("c_custkey", text.location_key(_case("Plano, TX, USA", _made(F.col("c_mktsegment"), " - United States"), None, "(US) Austin")).alias("key"))


@query("select c_custkey, case c_custkey % 4 when 0 then true when 1 then false when 2 then null else true end as remote from customer")
def infer_remote(spark, d):
    return _customers(spark, d).select("c_custkey", text.infer_remote(_case(_made("Remote - ", F.col("c_name")), "Remote or HYBRID", _made(F.col("c_name"), ", TX"), "Austin"), _case(None, "x", "Engineer", "Engineer (Work From Home)")).alias("remote"))


@query("select c_custkey, case c_custkey % 4 when 0 then 'Dallas ' || c_custkey when 1 then c_name when 2 then 'Allocations' else 'Austin' end as place from customer")
def clean_label(spark, d):
    return _customers(spark, d).select("c_custkey", text.clean_label(_case(_made("Job Locations: Dallas ", F.col("k")), F.col("c_name"), "Allocations", " location - Austin")).alias("place"))


@query("select c_custkey, case c_custkey % 4 when 0 then 'Dallas, ' || c_mktsegment when 1 then null when 2 then 'Austin' else 'X1 Road' end as place from customer")
def bullet_places(spark, d):
    key = F.concat(F.lit("R"), "k")
    b = F.when(_k() % 4 == 0, F.array(key, F.lit("Dallas "), "c_mktsegment")).when(_k() % 4 == 1, F.array(key, F.lit("JR-12345"), F.lit(" "))).when(_k() % 4 == 2, F.array(F.lit("Austin"), F.lit("Austin"), F.lit("2024-17"))).otherwise(F.array(F.lit("X1 Road")))
    return _customers(spark, d).select("c_custkey", text.place_of_bullets(b, F.concat(F.lit("/job/Name_"), key)).alias("place"))


@query("select c_custkey, c_custkey % 5 in (0, 3) as posting, c_custkey % 5 in (1, 2) as navigation from customer")
def posting_links(spark, d):
    """Link texts and addresses: postings, navigation, and neither."""
    title = _case(_made("Engineer ", F.col("k")), _made("View all jobs ", F.col("k")), "Apply Now", _made("Engineer for ", F.col("c_name")), _made("Engineer ", F.col("k")))
    href = _case(_made("/job/", F.col("k")), "/x", "/y", "#/detail/1", "mailto:a@b.example")
    return _customers(spark, d).select("c_custkey", text.is_posting_link(title, href).alias("posting"), text.is_navigation(title).alias("navigation"))


# ---------------------------------------------------------------- addresses and identities


@query("select c_custkey, case c_custkey % 4 when 0 then 'https://t.wd1.myworkdayjobs.com/wday/cxs/t/Site/job/Dallas/X_R' || c_custkey when 1 then 'https://t.wd1.myworkdayjobs.com/wday/cxs/t/S/job/' || c_custkey end as detail from customer")
def detail_url(spark, d):
    u = _case(_made("https://t.wd1.myworkdayjobs.com/en-US/Site/job/Dallas/X_R", F.col("k")), _made("https://t.wd1.myworkdayjobs.com/S/job/", F.col("k"), "?q=1"), _made("https://t.wd1.myworkdayjobs.com/job/", F.col("k")), _made("https://a.example/S/job/", F.col("k")))
    return _customers(spark, d).select("c_custkey", urls.detail(u).alias("detail"))


@query("select c_custkey, case c_custkey % 4 when 0 then 'acme' || c_custkey || '.com,www.acme' || c_custkey || '.com' when 1 then 'www.acme.com' when 2 then 'www.b.co.uk,b.co.uk' else 'www.acme.org,acme.org' end as hosts from customer")
def other_hosts(spark, d):
    h = _case(_made("careers.acme", F.col("k"), ".com"), "acme.com", "team.b.co.uk", "www.jobs.acme.org")
    return _customers(spark, d).select("c_custkey", F.array_join(F.filter(urls.other_hosts(h), lambda x: x != "jobs.acme.org"), ",").alias("hosts"))


@query("select c_custkey, 'https://acme.com/p' || case c_custkey % 4 when 2 then '?b=' || c_custkey else '' end as form from customer")
def duplicate_form(spark, d):
    return _customers(spark, d).select("c_custkey", urls.duplicate_form(_case("HTTP://www.Acme.com/p/", "https://acme.com/p#x", _made("http://acme.com:80/p?b=", F.col("k"), "&utm_source=q"), " https://www.acme.com/p ")).alias("form"))


@query("select c_custkey, 'acme|engineer ' || c_custkey || '|plano tx|https://a.example/' || c_custkey as key from customer")
def duplicate_key(spark, d):
    return _customers(spark, d).select("c_custkey", identity.duplicate_key(_case("Acme, Inc.", "ACME LLC", "The Acme Group"), _made("Engineer - ", F.col("k")), _case("Plano, TX", "Plano TX, USA"), _made("https://a.example/", F.col("k"), "?utm_source=", F.col("c_mktsegment"))).alias("key"))


# ---------------------------------------------------------------- providers

_SITES = ("https://acme{k}.wd5.myworkdayjobs.com/en-US/Careers/job/x", "https://boards.greenhouse.io/acme{k}/jobs/1", "https://acme{k}.icims.com/jobs", "https://jobs.lever.co/acme{k}", "https://careers.acme{k}.com/jobs")


@query("select c_custkey, ['workday', 'greenhouse', 'icims', 'lever', null][c_custkey % 5 + 1] as provider, case when c_custkey % 5 < 4 then 'acme' || c_custkey end as tenant, case when c_custkey % 5 = 0 then 'Careers' end as site from customer")
def provider_of_url(spark, d):
    """Provider, tenant and site of careers addresses."""
    u = _case(*[_made(*[p if p != "{k}" else F.col("k") for p in x.replace("{k}", "\n{k}\n").split("\n")]) for x in _SITES])
    return _customers(spark, d).select("c_custkey", providers.coordinates(u).alias("p")).select("c_custkey", "p.provider", "p.tenant", "p.site")


_PAGES = ('<a href="https://jobs.lever.co/acme{k}?x=1">', "<script src='https://x.icims.com/a/jquery.js'></script><a href='https://acme{k}.icims.com/jobs/search?a=1&amp;b=2'>", "<div class=ph-page>{k}</div>", '<a href="https://boards.greenhouse.io/a{k}"></a><a href="https://jobs.ashbyhq.com/b{k}">', "<p>{k}</p>")


def _boards():
    return _case(*[_made(*[p if p != "{k}" else F.col("k") for p in x.replace("{k}", "\n{k}\n").split("\n")]) for x in _PAGES])


@query(
    """select c_custkey, ['lever', 'icims', 'phenom', 'greenhouse', null][c_custkey % 5 + 1] as markup, case c_custkey % 5 when 0 then 'lever' when 1 then 'icims' when 2 then 'phenom' when 3 then 'greenhouse' else 'unknown' end as provider,
    case c_custkey % 5 when 0 then 'https://jobs.lever.co/acme' || c_custkey when 1 then 'https://acme' || c_custkey || '.icims.com/jobs/search?a=1&b=2' when 3 then 'https://boards.greenhouse.io/a' || c_custkey else 'https://acme.example' end as url from customer"""
)
def resolved_page(spark, d):
    """What a page's markup mentions, and the board that it embeds."""
    c = _customers(spark, d).withColumn("html", _boards())
    c = c.select("c_custkey", providers.by_markup(F.col("html")).alias("markup"), providers.resolve(F.lit("https://acme.example"), F.col("html")).alias("r"))
    return c.select("c_custkey", "markup", "r.provider", "r.url")


@query("select c_custkey, case c_custkey % 5 when 0 then 'https://jobs.lever.co/acme' || c_custkey when 1 then 'https://acme' || c_custkey || '.icims.com/jobs/search?a=1&b=2' when 3 then 'https://boards.greenhouse.io/a' || c_custkey else '' end as urls from customer")
def candidate_urls(spark, d):
    """Board addresses that a page reveals, of the provider that it mentions."""
    return _customers(spark, d).select("c_custkey", F.array_join(providers.candidates(_boards()), ",").alias("urls"))


# ---------------------------------------------------------------- filters and write-backs


@query("select c_custkey from customer where contains(lower(c_name), '#000000%1') or contains(c_name, '12')")
def company_contains(spark, d):
    """A needle is taken as it is, pattern signs and all."""
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("company"))
    return filters.company_contains(c, "12").unionByName(filters.company_contains(c, "#000000%1")).select("c_custkey")


@query("select c_custkey from customer where c_custkey % 3 = 0")
def company_named(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("company"))
    return filters.company_named(c, c.where("c_custkey % 3 = 0").select(F.concat(F.lit(" "), F.upper("company")).alias("company"))).select("c_custkey")


@query("select c_custkey, c_custkey % 6 in (0, 2, 3) as wanted from customer")
def needs_detail(spark, d):
    return _customers(spark, d).select("c_custkey", filters.needs_detail(_case("workday", "workday", "workday", "workday", "lever", "lever"), _case(_made(F.col("k"), " Locations"), _made("Dallas ", F.col("k")), None, " 2 location ", None, "3 Locations")).alias("wanted"))


@query("select c_custkey, c_custkey % 4 = 0 as ok from customer")
def storable(spark, d):
    return _customers(spark, d).select("c_custkey", filters.storable(_case(F.col("k"), "", F.col("k"), None), _case("u", "u", None, "u")).alias("ok"))


@query("select cast(o_custkey as varchar) as company from orders where o_orderstatus in ('F', 'P') group by 1")
def retryable(spark, d):
    """Companies of failed and partial rows, each once."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "partial").otherwise("success")
    r = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("company"), status.alias("status"), F.col("o_orderkey").alias("seq"))
    return filters.retryable(r).select("company")


@query("select c_custkey, case when n is null then 'old' when n > 9 then 'TRUE' else 'FALSE' end as status, case when n is null then -1 when n > 9 then n else 0 end as count from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def write_status(spark, d):
    """Visited companies say whether postings were found, and how many; others keep what they said."""
    t = _t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("company"), F.lit("old").alias("status"), F.lit(-1).cast("long").alias("count"))
    n = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).join(_t(spark, d, "customer"), F.col("o_custkey") == _k())
    return filters.write_status(t, n.select(F.col("c_name").alias("company"), F.when(F.col("n") > 9, F.col("n")).otherwise(0).alias("jobs"))).select("c_custkey", "status", "count")


@query(
    """select c_custkey, case when c_custkey % 4 = 3 then 'kept' when c_custkey % 2 = 0 then case when c_custkey % 4 = 0 then 'https://n/' || c_custkey else 'NOT FOUND' end end as suggestion,
    case when c_custkey % 4 = 0 and c_custkey % 3 = 0 then 'https://n/' || c_custkey else 'https://o/' || c_custkey end as ats_url from customer"""
)
def suggest(spark, d):
    """Suggestions only where there is none; a row that found nothing takes its own as its address."""
    t = _customers(spark, d).select("c_custkey", F.col("c_name").alias("company"), F.when(_k() % 3 == 0, "FALSE").otherwise("TRUE").alias("status"), F.when(_k() % 4 == 3, "kept").alias("suggestion"), _made("https://o/", F.col("k")).alias("ats_url"))
    found = _customers(spark, d).where(_k() % 4 != 1).select(F.col("c_name").alias("company"), F.when(_k() % 4 == 0, _made("https://n/", F.col("k"))).alias("url"))
    return filters.suggest(t, found, True).select("c_custkey", "suggestion", "ats_url")


@query("select c_custkey, c_custkey = 7 as same_name, c_custkey % 10 = 3 as same_url from customer where c_custkey = 7 or c_custkey % 10 = 3")
def proposed_duplicates(spark, d):
    """Rows of the workbook that a proposed company repeats, by name or by address."""
    t = _customers(spark, d).select("c_custkey", F.col("c_name").alias("company"), F.when(_k() % 10 == 3, "http://www.acme.example/jobs/").alias("ats_url"), _made("https://x/", F.col("k")).alias("live_jobs_url"))
    return filters.duplicates(t, " CUSTOMER#000000007 ", F.lit("https://acme.example/jobs")).select("c_custkey", "same_name", "same_url")


@query("select c_custkey, case when c_custkey % 4 = 0 then 'https://new/' || c_custkey else 'https://dead/' || c_custkey end as url from customer")
def replace_exact(spark, d):
    """A cell is overwritten only while it holds the address that was found dead."""
    t = _customers(spark, d).select("c_custkey", _made("https://dead/", F.col("k")).alias("url"))
    r = _customers(spark, d).where(_k() % 2 == 0).select("c_custkey", F.when(_k() % 4 == 0, _made("https://dead/", F.col("k"))).otherwise("https://other").alias("dead"), _made("https://new/", F.col("k")).alias("repaired"))
    return merge.replace_exact(t, r, "c_custkey", "url").select("c_custkey", "url")


# ---------------------------------------------------------------- remembered entries, digests, page signs


@query(
    """with h as (select c_custkey as k, c_name, cast(cast('0x' || substr(sha256(c_name), 1, 8) as bigint) % 7 as integer) as off, date '2024-01-20' + cast(c_custkey % 12 as integer) as today from customer)
    select k as c_custkey, k % 5 <> 0 and k % 7 <> 0 and date '2024-01-01' + 14 + off >= today as usable, case when k % 3 = 0 then 1 else greatest(1, cast(floor(k * 0.8) as bigint)) end as least from h"""
)
def usable_hints(spark, d):
    """Which remembered entries still save the discovery, and how many rows they must bring."""
    c = _customers(spark, d).select("c_custkey", F.col("c_name").alias("company"), F.when(_k() % 7 != 0, _made("https://e/", F.col("k"))).alias("entry_url"), F.lit(None).cast("string").alias("json_endpoint"), F.lit("2024-01-01").cast("date").alias("verified_at"), F.lit(None).cast("date").alias("checked_at"), (_k() % 5 == 0).alias("unsupported"), F.when(_k() % 3 != 0, _k()).alias("jobs"))
    today = F.date_add(F.lit("2024-01-20").cast("date"), (_k() % 12).cast("int"))
    return c.select("c_custkey", hints.usable(today).alias("usable"), hints.least_rows(F.col("jobs")).alias("least"))


@query("select c_custkey, (c_custkey % 3 > 0 or c_custkey % 5 = 0) and (c_custkey % 7 = 0 or c_custkey % 4 = 1 or (c_custkey % 4 in (2, 3) and c_custkey % 6 <= 3)) as send from customer")
def may_send(spark, d):
    """Whether a digest goes out: news, and a run whose gaps can be told."""
    reasons = F.when(_k() % 4 == 0, F.array().cast("array<string>")).when(_k() % 4 == 1, F.array(F.lit("page_ceiling"), F.lit("budget_exhausted"))).otherwise(F.array(F.lit("page_failed"), F.lit("budget_exhausted")))
    return _customers(spark, d).select("c_custkey", hints.may_send(_k() % 3, F.when(_k() % 5 == 0, 1).otherwise(0), _k() % 7 == 0, reasons, _k() % 6).alias("send"))


@query("select c_custkey, case when said <= 100000 then said end as total, c_custkey % 5 = 0 as blocked from (select c_custkey, case c_custkey % 4 when 0 then c_custkey + 20 when 1 then 99 when 2 then c_custkey end as said from customer)")
def page_texts(spark, d):
    """Counts that pages state, and pages that keep robots out."""
    said = _case(_made("Showing 1 - 20 of ", (_k() + 20).cast("string"), " jobs"), "99 openings, 3 results", _made("total: ", F.col("k")), _made("999999", F.col("k"), " jobs"))
    title = F.when(_k() % 5 == 0, "Access Denied").otherwise("Jobs")
    return _customers(spark, d).select("c_custkey", pages.stated_total(said).alias("total"), pages.blocked(title, said).alias("blocked"))
