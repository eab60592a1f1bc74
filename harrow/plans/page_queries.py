"""Registered queries of recorded pages and payloads, each with the same result in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import dates, identity
from ..operators import walk
from ..sinks import places
from ..sources import markup, pages, recorded, vendors
from .queries import SQL, _t, query, supplier_pages

# ---------------------------------------------------------------- vendors' payloads

_BASE = "https://h.example/"


def _links_of(provider: str):
    """(what comes before the value, what after) of the address that a provider's fixture gets."""
    t = vendors.MAPPINGS[provider]["url"][0]
    if isinstance(t, str):
        return _BASE + "x/", ""
    fill = lambda x: x.replace("{site}", "S1").replace("{corp}", "C1")
    return _BASE + fill(t[0]), fill(t[2])


_ASKED = ", ".join(f"('{p}', '{_links_of(p)[0]}', '{_links_of(p)[1]}')" for p in vendors.MAPPINGS)


def _payloads(spark, d, provider: str):
    """Suppliers as postings of their nations, in a provider's payload: one body a nation."""
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    whole = isinstance(vendors.MAPPINGS[provider]["url"][0], str)
    row = vendors.payload(provider, {"title": F.concat(F.lit(" Role&amp;"), key), "location": F.col("n_name"), "date": F.concat(F.lit("2024-01-"), key), "url": F.concat(F.lit(_BASE + "x/"), key) if whole else key})
    return s.select("n_name", row.alias("row")).groupBy("n_name").agg(vendors.wrap(provider, F.collect_list("row")).alias("body")).withColumns({"company": F.col("n_name"), "base": F.lit(_BASE), "site": F.lit("S1"), "corp": F.lit("C1")})


_SHOWN = ("company", "title", "location", "date_text", "job_url", "ats_provider")


@query(
    f"""with a as (select * from (values {_ASKED}) as v(mapping, before, after)), s as (select *, cast(s_suppkey as varchar) as k from supplier join nation on s_nationkey = n_nationkey)
    select mapping, n_name as company, 'Role&' || k as title, n_name as location, '2024-01-' || k as date_text, before || k || after as job_url, string_split(mapping, '_')[1] as ats_provider from s cross join a"""
)
def vendor_records(spark, d):
    """Every provider's payload form, read by its mapping."""
    parts = [vendors.records(_payloads(spark, d, p), p).select(F.lit(p).alias("mapping"), *_SHOWN) for p in vendors.MAPPINGS]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    f"""with a as (select * from (values {_ASKED}) as v(mapping, before, after) where mapping in ('phenom_page', 'paylocity_page', 'cornerstone')), s as (select *, cast(s_suppkey as varchar) as k from supplier join nation on s_nationkey = n_nationkey)
    select mapping, n_name as company, 'Role&' || k as title, before || k || after as job_url from s cross join a"""
)
def vendor_page_objects(spark, d):
    """Payloads that stand in pages' scripts, after a mark and among braces."""
    parts = []
    for name, mark, told in (("phenom_page", "phenom", "phApp.ddo = "), ("paylocity_page", "paylocity", "window.pageData = "), ("cornerstone", "cornerstone", "csod.context = ")):
        p = _payloads(spark, d, name)
        page = F.concat(F.lit("<script>var f = {a: {}}; " + told), "body", F.lit("; if (x) { y(); }</script><p>{</p>"))
        parts.append(vendors.records(p.withColumn("body", markup.page_object(page, markup.MARKS[mark])), name).select(F.lit(name).alias("mapping"), "company", "title", "job_url"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _cards(spark, d, start: str, card, end: str, base: str = _BASE):
    """Pages of a nation's suppliers: card(key, place) each, between start and end."""
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    cards = s.groupBy("n_nationkey").agg(F.array_join(F.collect_list(card(F.col("s_suppkey").cast("string"), F.col("n_name"))), "").alias("c"))
    return cards.select(F.col("n_nationkey").cast("long").alias("page_id"), F.lit(base).alias("url"), F.concat(F.lit(start), "c", F.lit(end)).alias("html"))


_ROLE = "with s as (select s_suppkey as k, cast(n_nationkey as bigint) as page_id, n_name from supplier join nation on s_nationkey = n_nationkey) select page_id, 'Role ' || k as title, {place} as location, {url} as job_url from s"


@query(_ROLE.format(place="n_name", url="'https://h.example/job/' || k"))
def radancy_cards(spark, d):
    card = lambda k, n: F.concat(F.lit('<li><a href="/job/'), k, F.lit('" data-job-id="1"><h2>Role '), k, F.lit('</h2><span class="job-date">x</span><span class="job-location">Location: '), n, F.lit('</span></a><a href="/job/9"><h2>no id</h2></a></li>'))
    page = _cards(spark, d, "<ul>", card, "</ul>")
    return markup.vendor_rows(page.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.to_json(F.struct(F.col("html").alias("results")))).otherwise(F.col("html"))), "radancy")


@query(_ROLE.format(place="n_name", url="'https://jobs.jobvite.com/acme/job/' || k"))
def jobvite_table(spark, d):
    card = lambda k, n: F.concat(F.lit('<tr><td class="jv-job-list-name x"><a href="/acme/job/'), k, F.lit('">Role '), k, F.lit('</a></td><td class="jv-job-list-location"> '), n, F.lit("\n</td></tr><tr><td><a href='/acme/job/0'>other</a></td></tr>"))
    return markup.vendor_rows(_cards(spark, d, "<table>", card, "</table>", "https://jobs.jobvite.com/acme/"), "jobvite")


@query(_ROLE.format(place="case when k % 2 = 0 then n_name || ', US' else n_name end", url="'https://h.example/j/' || k"))
def endpoint_rows(spark, d):
    """Answers of a remembered endpoint: job-shaped objects at any depth."""
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey").cast("string")
    one = F.when(F.col("s_suppkey") % 2 == 0, F.to_json(F.struct(F.concat(F.lit("Role "), k).alias("jobTitle"), F.struct(F.col("n_name").alias("city"), F.lit("US").alias("country")).alias("Location"), F.concat(F.lit("/j/"), k).alias("url"))))
    one = one.otherwise(F.to_json(F.struct(F.concat(F.lit("Role "), k).alias("title"), F.col("n_name").alias("city"), F.concat(F.lit("https://h.example/j/"), k).alias("applyUrl"))))
    body = s.groupBy("n_nationkey").agg(F.concat(F.lit('{"data": {"facets": [{"title": "no link"}], "rows": ['), F.array_join(F.collect_list(one), ", "), F.lit("]}}")).alias("html"))
    return markup.vendor_rows(body.select(F.col("n_nationkey").cast("long").alias("page_id"), F.lit(_BASE).alias("url"), "html"), "endpoint")


_MADE = {"icims": '<a class="iCIMS_Anchor" href="/x/{k}">', "successfactors": '<a href="/job/{k}">', "avature": '<a href="/c/JobDetail/{k}">'}


@query(
    " union all ".join(
        f"select '{v}' as vendor, page_id, case when page_id % 2 = 0 then 'Role ' else 'Posting ' end || k as title, case when page_id % 2 = 1 then n_name end as location, 'https://h.example/' || case when page_id % 2 = 0 then '{p}' else 'p/' end || k as job_url from s"
        for v, p in (("icims", "x/"), ("successfactors", "job/"), ("avature", "c/JobDetail/"))
    ).replace("select 'icims'", "with s as (select s_suppkey as k, cast(n_nationkey as bigint) as page_id, n_name from supplier join nation on s_nationkey = n_nationkey) select 'icims'", 1)
)
def listed_pages(spark, d):
    """Result pages of vendors: JSON-LD where there is some (odd pages), links to postings elsewhere."""
    parts = []
    for vendor, a in _MADE.items():
        before, after = a.split("{k}")
        link = lambda k, n, b=before, e=after: F.concat(F.lit(b), k, F.lit(e + "Role "), k, F.lit("</a><a href='/about'>About us</a>"))
        node = lambda k, n: F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.concat(F.lit("Posting "), k).alias("title"), F.concat(F.lit("https://h.example/p/"), k).alias("url"), F.struct(F.struct(n.alias("addressLocality")).alias("address")).alias("jobLocation"))), F.lit("</script>"))
        both = lambda k, n, link=link, node=node: F.when(F.col("n_nationkey") % 2 == 1, F.concat(node(k, n), link(k, n))).otherwise(link(k, n))
        parts.append(markup.listed(_cards(spark, d, "<div>", both, "</div>"), vendor).withColumn("vendor", F.lit(vendor)))
    return reduce(lambda a, b: a.unionByName(b), parts)


# ---------------------------------------------------------------- pages

_SEEN = r"""seen as (select page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', chr(34), 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g')) as text from pages)"""


@query(f"with {_SEEN} select page_id, text from seen")
def visible_text(spark, d):
    """What a reader sees of each page; labels for screen readers, added to every page here, are not."""
    p = _t(spark, d, "pages")
    made = F.regexp_replace("html", "<article>", '<article><span class="x sr-only">Label <b>of</b></span>')
    return p.select("page_id", markup.visible_text(made).alias("text"))


_SIGNS = ['<a rel="next" href="/z">z</a>', '<div class="my-pagination"></div>', "<button>Load more</button>", '<a href="/z?page=2">z</a>', '<a href="/z">View all open jobs</a>', "<p>1-10 of 1,234</p>", "<p>7 open positions</p>", ""]
_NAMED = ['<a href="/z">Careers</a>', '<a href="/careers">z</a><a href="/q">our careers</a>', '<a href="mailto:jobs">jobs</a>', ""]


@query(
    """with p as (select page_id, page_id % 8 as s, page_id % 4 as c, case when page_id % 3 = 0 then 3 else 2000 end as rows, page_id % 5 = 0 as long, page_id % 5 = 1 as search from pages)
    select page_id, cast(case s when 5 then 1234 when 6 then 7 end as bigint) as total, case s when 0 then 'next link' when 1 then 'pager' when 2 then 'more button' when 3 then 'page link' when 4 then case when rows = 3 then 'link to all' end when 5 then case when rows = 3 then 'stated total' end when 6 then case when rows = 3 then 'stated total' end end as more,
    case c when 0 then 'https://s.example/z' when 1 then 'https://s.example/q' end as careers_link, long as careers_page, case when c = 1 then '' else '' end as list_links from p"""
)
def page_signs(spark, d):
    """Pages made of known parts: signs of more results, careers links, whether it is a careers page."""
    k = F.col("page_id")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    filler = F.when(k % 5 == 0, F.concat(F.lit("<a href='/vacancies1'>Engineer here</a>"), F.expr("repeat('<i> x </i>', 300)"))).when(k % 5 == 1, F.lit("<input value='job search'>")).otherwise(F.expr("repeat('<i> x </i>', 300)"))
    made = _t(spark, d, "pages").select("page_id", F.lit("https://s.example/").alias("url"), F.concat(F.lit("<html><body>"), pick(_SIGNS), pick(_NAMED), filler, F.lit("</body></html>")).alias("html"))
    out = markup.page_signs(made, F.when(k % 3 == 0, 3).otherwise(2000))
    return out.select("page_id", "total", "more", "careers_link", "careers_page", F.array_join(F.filter("list_links", lambda x: ~x.contains("vacancies1")), ",").alias("list_links"))


@query("select page_id, case when page_id % 3 = 0 then '/jobs/' || page_id || ',/search' when page_id % 3 = 1 then '/search' else '' end as links from pages")
def job_list_links(spark, d):
    """The first distinct links of a page that look like job lists'."""
    k = F.col("page_id").cast("string")
    body = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<a href='/jobs/"), k, F.lit("'>a</a><a href='#/jobs'>b</a><a href='/search'>c</a><a href='/jobs/"), k, F.lit("'>d</a>"))).when(F.col("page_id") % 3 == 1, F.lit("<a href='/search'>x</a><a href='/x'>y</a>")).otherwise(F.lit("<a href='javascript:/jobs'>z</a>"))
    made = _t(spark, d, "pages").select("page_id", F.lit("https://s.example").alias("url"), body.alias("html"))
    return markup.page_signs(made, F.lit(0)).select("page_id", F.replace(F.array_join("list_links", ","), F.lit("https://s.example"), F.lit("")).alias("links"))


_BRACES = "select page_id, case page_id % 4 when 0 then '{\"a\": {\"b\": ' || page_id || '}}' when 1 then '{}' end as object from pages"


@query(_BRACES)
def balanced_json(spark, d):
    """The object after a mark: nested, empty, cut off, and none."""
    k = F.col("page_id").cast("string")
    body = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('x {y} m = {"a": {"b": '), k, F.lit("}}; }"))).when(F.col("page_id") % 4 == 1, "m = {}{}").when(F.col("page_id") % 4 == 2, 'm = {"a": {').otherwise("{}")
    return _t(spark, d, "pages").select("page_id", markup.page_object(body, r"m\s*=\s*").alias("object"))


@query("select page_id, 'Posting ' || page_id as title, 'Town, ST' as location, 'https://p.example/' || page_id as job_url from pages where page_id % 2 = 0")
def jsonld_jobs(spark, d):
    """Postings of pages' JSON-LD: every second page holds one, below @graph; scripts that do not parse are passed over."""
    k = F.col("page_id").cast("string")
    node = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": ["X", "jobposting"], "title": "Posting '), k, F.lit('", "url": "https://p.example/'), k, F.lit('", "jobLocation": [{}, {"address": {"addressLocality": "Town", "addressRegion": "ST"}}]}]}</script>'))
    made = _t(spark, d, "pages").withColumn("html", F.concat(F.lit('<script type="application/ld+json">{broken</script>'), F.when(F.col("page_id") % 2 == 0, node).otherwise(""), "html"))
    return pages.jsonld_jobs(made).select("page_id", "title", "location", "job_url")


@query("select page_id, 'Role ' || page_id as title, 'https://p.example/r/' || page_id as job_url from pages where page_id % 3 <> 2")
def payload_jobs(spark, d):
    """Postings in the objects that scripts of pages hold for their framework."""
    k = F.col("page_id").cast("string")
    inner = F.concat(F.lit('{"props": {"pad": "'), F.lit("x" * 200), F.lit('", "list": [{"title": "Role '), k, F.lit('", "url": "/r/'), k, F.lit('"}, {"title": "no address"}]}}'))
    made = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), inner, F.lit("</script>"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<script>window.__STATE__ = "), inner, F.lit(";</script>"))).otherwise("")
    return pages.payload_jobs(_t(spark, d, "pages").select("page_id", F.lit("https://p.example/x").alias("url"), F.concat("html", made).alias("html")))


# ---------------------------------------------------------------- identities, dates, walks

#: (provider, what comes before a key, after it, before its id, an id or else the canonical address)
_POSTED = [("workday", "https://t.wd1.myworkdayjobs.com/s/job/X_R", "", "workday:R", ""), ("greenhouse", "https://boards.greenhouse.io/a/jobs/", "0000", "greenhouse:", "0000"), ("lever", "https://jobs.lever.co/a/", "-", "https://jobs.lever.co/a/", "-"), ("unknown", "https://a.example/x?utm_source=q&jobId=", "&z=1", "", ""), ("unknown", "https://a.example/p/", "-name?b=2", "https://a.example/p/", "-name?b=2"), (None, "https://a.example/p/0000", "/", "0000", "")]
_ID_ROWS = ", ".join(f"({i}, {repr(a)}, {repr(b)}, {repr(c)}, {repr(e)})" for i, (_, a, b, c, e) in enumerate(_POSTED))


@query(f"with v as (select * from (values {_ID_ROWS}) as v(i, a, b, c, e)) select c_custkey, 'acme:' || c || c_custkey || e as job_id from customer join v on c_custkey % {len(_POSTED)} = i")
def posting_ids(spark, d):
    """Identities by vendors' own ids, query parameters, path numbers and canonical addresses."""
    k = F.col("c_custkey")
    at = lambda i: F.element_at(F.array(*[F.lit(p[i]).cast("string") for p in _POSTED]), (k % len(_POSTED) + 1).cast("int"))
    return _t(spark, d, "customer").select("c_custkey", identity.job_id(F.concat(at(1), k.cast("string"), at(2)), at(0), F.lit("Acme, Inc.")).alias("job_id"))


_NOW = "2024-01-31 00:00:00"
#: Written forms of a date, as Spark's formats: with seconds, to the minute, the day only, with offsets.
_TO_SECOND = """yyyy-MM-dd'T'HH:mm:ss'Z'|yyyy-MM-dd'T'HH:mm:ss|yyyy-MM-dd HH:mm:ss|yyyy-MM-dd'T'HH:mm:ss'+0000'|yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'|yyyy-MM-dd HH:mm:ss'+00:00'|EEE, dd MMM yyyy HH:mm:ss 'GMT'
MM/dd/yyyy hh:mm:ss a|EEE MMM dd HH:mm:ss yyyy|d MMMM yyyy HH:mm:ss|'Posted on: 'yyyy-MM-dd HH:mm:ss""".replace("\n", "|").split("|")
_TO_MINUTE = "yyyy-MM-dd'T'HH:mm'Z'|yyyy-MM-dd HH:mm|MMM d, yyyy hh:mm a|MMMM d, yyyy 'at' h:mm a|MM/dd/yyyy HH:mm|d MMM yyyy, HH:mm|EEEE, MMMM d, yyyy h:mma".split("|")
_TO_DAY = """yyyy-MM-dd|yyyy/MM/dd|MM/dd/yyyy|M/d/yy|MM-dd-yyyy|MMMM d, yyyy|MMM d, yyyy|MMM. d, yyyy|d MMM yyyy|d MMMM yyyy|dd-MMM-yyyy|d-MMMM-yy|EEEE, MMMM d, yyyy|EEEE d MMMM yyyy|MMMM d'th', yyyy|d'th of' MMMM yyyy|yyyy MMM dd
MMM d|d MMMM|'Date posted: 'MMMM d, yyyy|'Published 'd MMM yyyy|'closing 'MMMM d, yyyy' for all'""".replace("\n", "|").split("|")
_SHIFTED = {"yyyy-MM-dd'T'HH:mm:ss'+05:30'": -19800, "yyyy-MM-dd HH:mm:ss' -0700'": 25200, "EEE, d MMM yyyy HH:mm:ss' +0200'": -7200}
_FORMS = [*_TO_SECOND, *_TO_MINUTE, *_TO_DAY, *_SHIFTED]
_S, _M, _D = len(_TO_SECOND), len(_TO_SECOND) + len(_TO_MINUTE), len(_TO_SECOND) + len(_TO_MINUTE) + len(_TO_DAY)
_N = len(_FORMS) + 7
_SHIFTS = " ".join(f"when f = {_D + i} then t + interval ({x}) second" for i, x in enumerate(_SHIFTED.values()))


@query(
    f"""with e as (select event_id, date_trunc('second', ts) as t, event_id % {_N} as f, (event_id // {_N}) % 9 + 1 as n from events),
    w as (select *, case when f < {_S} then t when f < {_M} then date_trunc('minute', t) when f < {_D} then date_trunc('day', t) {_SHIFTS} end as written from e)
    select event_id, case when f < {len(_FORMS)} then case when epoch(written) - epoch(timestamp '{_NOW}') <= 2 * 86400 then written end
    when f = {len(_FORMS)} then timestamp '{_NOW}' - n * interval 1 hour when f = {len(_FORMS) + 1} then timestamp '{_NOW}' - n * interval 7 day when f = {len(_FORMS) + 2} then timestamp '{_NOW}' - n * interval 30 day
    when f = {len(_FORMS) + 3} then timestamp '{_NOW}' - interval 1 day when f = {len(_FORMS) + 4} then t end as parsed from w"""
)
def written_dates(spark, d):
    """Dates in over 40 written forms, phrases, epochs, and texts that are no dates."""
    k, t = F.col("event_id"), F.date_trunc("second", F.col("ts")).cast("timestamp")
    n = (F.floor(k / _N) % 9 + 1).cast("string")
    said = [F.date_format(t, f) for f in _FORMS]
    said += [F.concat(n, F.lit(" hours ago")), F.concat(F.lit("Posted "), n, F.lit("+ Weeks Ago")), F.concat(n, F.lit(" months old")), F.lit("Posted Yesterday"), F.concat(F.unix_seconds(t).cast("string"), F.lit("000")), F.concat(F.lit("Suite "), n), F.concat(n, F.lit(" openings"))]
    text = F.coalesce(*[F.when(k % _N == i, s) for i, s in enumerate(said)])
    return _t(spark, d, "events").select("event_id", dates.parse(text, F.lit(_NOW).cast("timestamp")).cast("timestamp_ntz").alias("parsed"))


@query("select cast(l_suppkey as bigint) as source, cast(least(100, ceil(count(*) / 20.0) * 20) as bigint) as collected, case when count(*) > 80 then 'budget_exhausted' else 'exhausted' end as stop_reason from lineitem group by 1 having count(*) > 80")
def walk_budget(spark, d):
    """Walks of suppliers with many lines, in pages of 20, under a budget of 90 rows."""
    from pyspark.sql import Window as W

    lines = _t(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("source"), "l_orderkey", "l_linenumber", "l_partkey")
    rows, by = lines.count(), W.partitionBy("source")
    n = walk.dealt(lines, rows, "source").select("source", (F.row_number().over(by.orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1).alias("rn"), F.count("*").over(by).alias("c"))
    n = n.where("c > 80").withColumn("page_no", F.floor(F.col("rn") / 20).cast("int"))
    log = n.groupBy("source", "page_no").agg(F.array_sort(F.collect_list("rn")).alias("rows"))
    out = walk.walk(log.withColumns({"total": F.lit(None).cast("long"), "failed": F.lit(False)}), most=90, rows=rows)
    return out.select("source", "collected", "stop_reason")


@query("select k as source, least(500, n) as pages, case when n >= 500 then 'page_ceiling' else 'exhausted' end as stop_reason, n < 500 as complete from (select event_id % 16 as k, count(*) as n from events group by 1)")
def walk_ceiling(spark, d):
    """Walks that get one row a page, against the ceiling of pages."""
    from pyspark.sql import Window as W

    k = F.col("event_id") % 16
    nth = F.row_number().over(W.partitionBy(k).orderBy("event_id")) - 1
    events = _t(spark, d, "events")
    log = events.select(k.alias("source"), nth.alias("page_no"), F.array("event_id").alias("rows"), F.lit(None).cast("long").alias("total"), F.lit(False).alias("failed"))
    return walk.walk(log, rows=events.count()).select("source", "pages", "stop_reason", "complete")


@query(SQL["page_walk"])
def recorded_walk(spark, d):
    """The walks of page_walk replayed from recorded exchanges, with answers that fail before a good one."""
    p, at = supplier_pages(spark, d), places.scratch(spark, "exchanges")
    again = (F.col("page_no") % 4 == 1) | F.col("failed")
    tries = p.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.when(again, 1).otherwise(0))))
    bad = F.col("failed") | (again & (F.col("attempt") == 0))
    log = tries.select(F.col("source").cast("string").alias("source"), "page_no", "attempt", F.when(bad, 503).otherwise(200).alias("status"), F.lit(None).cast("double").alias("retry_after"), F.when(~bad, F.col("rows").cast("array<string>")).alias("rows"), "total", F.lit(False).alias("stale"))
    recorded.write(log, at, _t(spark, d, "lineitem").count())
    recorded.register(spark)
    out = spark.read.format("recorded").options(path=at, most=10**9, perPartition=16).load()
    return out.select(F.col("source").cast("long").alias("source"), "pages", F.col("offset").alias("received"), "collected", "total", "stop_reason", "complete", "shortfall")
