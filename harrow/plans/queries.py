"""Registered queries over the given tables, each with the same result in SQL.

The tables stand in for records: pages for postings' URLs, events for sightings, orders for exports,
lineitem for copies of a posting, documents for titles with descriptions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import dates, identity, matching, text, urls
from ..operators import dedup, lifecycle, merge, report, walk
from ..operators.buckets import BucketStore
from ..sinks import places

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- URLs and identity

_TRACK = ", ".join(f"'{p}'" for p in urls.TRACKING)
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?([^#]*))?"
#: canonical URLs of pages; their parameters hold no escapes, so decoding and encoding change nothing
_CANON = f"""
 u0 as (select page_id, url, lower(regexp_extract(url, '{_PARTS}', 1)) as scheme,
   regexp_replace(regexp_replace(lower(regexp_extract(url, '{_PARTS}', 2)), ':80$', ''), ':443$', '') as host,
   regexp_replace(regexp_extract(url, '{_PARTS}', 3), '/+$', '') as path, regexp_extract(url, '{_PARTS}', 5) as query from pages),
 pairs as (select page_id, unnest(string_split(query, '&')) as pair from u0),
 kept as (select page_id, string_agg(pair, '&' order by split_part(pair, '=', 1), pair) as q from pairs
   where strpos(pair, '=') > 0 and split_part(pair, '=', 2) <> '' and lower(split_part(pair, '=', 1)) not in ({_TRACK}) group by page_id),
 canon as (select u0.page_id, u0.url, host, case when path = '' then '/' else path end as path,
   scheme || '://' || host || (case when path = '' then '/' else path end) || coalesce('?' || q, '') as canonical from u0 left join kept using (page_id))"""


@query(f"with {_CANON} select canonical, min(page_id) as page_id, count(*) as copies, min_by(url, page_id) as url from canon group by canonical")
def url_canonical(spark, d):
    """Distinct canonical pages with the earliest copy of each."""
    p = _t(spark, d, "pages").select("page_id", "url", urls.normalize(F.col("url")).alias("canonical"))
    return p.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"), F.min_by("url", "page_id").alias("url"))


@query(
    f"""with {_CANON}, r as (select string_split(host, '.') as l from canon)
    select case when len(l) < 2 then array_to_string(l, '.') when len(l) > 2 and l[len(l)-1] in ('co','com','org','net','gov','ac') then array_to_string(l[len(l)-2:], '.') else array_to_string(l[len(l)-1:], '.') end as root,
    count(*) as n from r group by 1"""
)
def url_root_domain(spark, d):
    p = _t(spark, d, "pages").select(urls.root_domain(F.col("url")).alias("root"))
    return report.counts(p, "root")


@query(
    """with j as (select page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages)
    select page_id, host <> '' and not regexp_matches(host, '^(localhost|127\\.|10\\.|192\\.168\\.)') as safe, cast(null as varchar) as problem from j"""
)
def url_checks(spark, d):
    u = F.col("url")
    return _t(spark, d, "pages").select("page_id", urls.safe_to_fetch(u).alias("safe"), urls.problem(u).alias("problem"))


@query(
    f"""with {_CANON}, i as (select page_id, canonical, regexp_extract(split_part(regexp_replace(path, '/+$', ''), '/', -1), '([0-9]{{4,}})$', 1) as num from canon)
    select page_id, 'site:' || case when num <> '' then num else canonical end as job_id from i"""
)
def job_identity(spark, d):
    return _t(spark, d, "pages").select("page_id", identity.job_id(F.col("url"), F.lit("unknown"), F.lit("Site, Inc.")).alias("job_id"))


@query("select c_custkey, sha1(c_name || chr(31) || n_name || chr(31) || coalesce(c_mktsegment, '')) as record_hash from customer join nation on c_nationkey = n_nationkey")
def record_hash(spark, d):
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", identity.record_hash(F.col("c_name"), F.col("n_name"), F.col("c_mktsegment")).alias("record_hash"))


@query("select c_custkey, case when c_acctbal < 0 then 'changed:' || substr(sha1(c_name), 1, 12) else 'new' end as kind from customer")
def notification_kind(spark, d):
    return _t(spark, d, "customer").select("c_custkey", identity.notification_kind(F.col("c_acctbal") < 0, identity.record_hash(F.col("c_name"))).alias("kind"))


@query("select c_custkey, cast(cast('0x' || substr(sha256(c_name), 1, 8) as bigint) % 14 as bigint) as due from customer")
def hint_stagger(spark, d):
    return _t(spark, d, "customer").select("c_custkey", identity.stagger(F.col("c_name"), 14).alias("due"))


@query(
    r"""with p as (select page_id, regexp_extract(url, '^([^?#]*)', 1) as path, regexp_extract(url, '\?([^#]*)', 1) as q, url from pages), h as (select page_id, url, regexp_extract(path, '^[a-z]+://[^/]*/([^/]*)', 1) as path, q from p)
    select path, count(distinct q) as n_queries, min_by(url, page_id) as url from h group by path having count(distinct q) >= 2"""
)
def json_endpoint(spark, d):
    """Sections of the sites asked with several queries, as endpoints are found."""
    p = _t(spark, d, "pages")
    return report.busiest_path(p, F.element_at(F.split(urls.part(F.col("url"), 3), "/"), 2), urls.part(F.col("url"), 4), "page_id")


# ---------------------------------------------------------------- text

_TOKEN = r"trim(regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"select p_partkey, {_TOKEN.format(c='p_name')} as token, coalesce({_TOKEN.format(c='p_type')}, '') as kind from part")
def norm_token(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.token(F.col("p_name")).alias("token"), text.token(F.col("p_type")).alias("kind"))


@query(
    "select s_suppkey, array_to_string(list_filter(string_split("
    + _TOKEN.format(c="s_name || ', Inc. Holdings'")
    + ", ' '), lambda w: w not in ("
    + ", ".join(f"'{w}'" for w in text.COMPANY_SUFFIXES)
    + ")), ' ') as company from supplier"
)
def norm_company(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", text.company_key(F.concat("s_name", F.lit(", Inc. Holdings"))).alias("company"))


@query(
    r"""with t as (select page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') as x from pages), u as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', chr(34), 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') as x from t),
    s as (select page_id, trim(regexp_replace(x, '[\s\x0b\x85\p{Z}]+', ' ', 'g')) as x from u) select page_id, case when length(x) > 5000 then rtrim(substr(x, 1, 5000)) || '...' else x end as stripped from s"""
)
def strip_html(spark, d):
    return _t(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("stripped"))


@query(r"select doc_id, case when regexp_matches(line, '^[=+\-@\t\r]') then '''' || line else line end as cell from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)")
def escape_formula(spark, d):
    lines = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", text.escape_formula(F.col("line")).alias("cell"))


@query("select n_nationkey, case when n_name is null or lower(trim(n_name)) in ('', 'nan', 'none', 'n/a', 'na', '-', 'null') then null else n_name || ', ' || r_name end as place from nation join region on n_regionkey = r_regionkey")
def join_location(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.when(~text.is_blank(F.col("n_name")), text.join_location(F.col("n_name"), F.col("r_name"), F.col("n_name"))).alias("place"))


@query(
    """select event_id, case when s < 60 then s || case when s = 1 then ' second' else ' seconds' end when s < 3600 then (s // 60) || case when s // 60 = 1 then ' minute' else ' minutes' end
    else (s // 3600) || 'h ' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || 'm' end as spent from (select event_id, cast(floor(greatest(value, 0) * 100) as bigint) as s from events)"""
)
def humanize(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", text.humanize(F.floor(F.col("value") * 100)).alias("spent"))


# ---------------------------------------------------------------- filters

_WANT, _NOT = (r"\bthe\b", r"\bder\b", r"\bla\b"), (r"^\s*of\b", r"\bund\b")
_SKILLS = {"the": (r"\bthe\b",), "of": (r"\bof\b",), "and": (r"\band\b",), "with": (r"\bwith\b",), "der": (r"\bder\b", r"\bdie\b"), "que": (r"\bque\b",), "para": (r"\bpara\b",), "ist": (r"\bist\b",)}


def _word(p: str) -> str:
    """The pattern for an engine whose word edges are ASCII: letters of any script are letters."""
    return p.replace(r"\b", r"(?:^|$|[^\p{L}\p{N}\p{M}_])")


@query(
    "with t as (select doc_id, split_part(text, chr(10), 1) as title from documents), s as (select doc_id, title, unnest(list_concat(regexp_split_to_array(title, '[,;|/\\\\–—]|\\s+-\\s+|\\(|\\)|\\[|\\]'), [title])) as part from t)"
    + f" select doc_id, bool_or(regexp_matches(trim(part), '(?i){'|'.join(map(_word, _WANT))}')) and not regexp_matches(any_value(title), '(?i){'|'.join(map(_word, _NOT))}') as wanted from s group by doc_id"
)
def role_filter(spark, d):
    """First lines as titles, with lists of the tables' own words."""
    t = _t(spark, d, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return t.select("doc_id", matching.role(F.col("title"), _WANT, _NOT).alias("wanted"))


_HITS = ", ".join(f"case when {' or '.join(f'''regexp_matches(x, '(?i){_word(p)}')''' for p in ps)} then '{k}' end" for k, ps in _SKILLS.items())


@query(f"with t as (select doc_id, lower(text) as x, trim(text) = '' as none from documents), h as (select doc_id, none, list_filter([{_HITS}], lambda y: y is not null) as hits from t) select doc_id, case when not none then cast(round_even(100.0 * len(hits) / {len(_SKILLS)}, 0) as integer) end as score, array_to_string(hits, ', ') as matched from h")
def fit_score(spark, d):
    f = matching.fit(F.lit(""), F.col("text"), _SKILLS)
    return _t(spark, d, "documents").select("doc_id", f.alias("f")).select("doc_id", "f.score", F.array_join("f.matched", ", ").alias("matched"))


_PLACE = ["Remote - ", "Remote, ", "Hybrid - ", "Dallas, TX / ", "Plano, Texas; ", "Work from home (", "Austin, TX or Remote ", "Arlington, VA ", "Frisco ", "Remote - New York ", "Anywhere in the US ", "1 Nationwide Blvd "]
_CASES = " ".join(f"when {i} then '{p}'" for i, p in enumerate(_PLACE))


def _places(spark, d):
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    opening = F.element_at(F.array(*[F.lit(p) for p in _PLACE]), (F.col("c_custkey") % len(_PLACE) + 1).cast("int"))
    return c.select("c_custkey", F.concat(opening, F.initcap("n_name")).alias("location"), F.col("c_mktsegment").alias("title"))


_STATES_RE = "|".join(matching.STATES.values())
_OTHER = "|".join(v for k, v in matching.STATES.items() if k != "tx")
_OTHER_CODES = "|".join(k for k in matching.STATES if k != "tx")
_ABROAD = "|".join(matching.ABROAD)
_CITY = "|".join(c.replace("/", "/") for c in matching.CITIES)
_LOC = f"""l as (select c_custkey, case c_custkey % {len(_PLACE)} {_CASES} end || upper(n_name[1]) || lower(n_name[2:]) as location, coalesce(c_mktsegment, '') as title from customer join nation on c_nationkey = n_nationkey),
 h as (select *, lower(location) || ' ' || lower(title) as hay from l),
 r as (select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(location), '\\b(anywhere in the us|work from home|work-from-home|telecommute|remote - us|distributed|home based|home-based|nationwide|us-remote|anywhere|virtual|remote|wfh)\\b', ' ', 'g'), '[^a-z0-9_\\s]', ' ', 'g'), '\\b(in|the|and|or|of|only|based|position|role|usa?)\\b', ' ', 'g'), '\\s+', ' ', 'g')) as residue from h),
 s as (select *, case when regexp_matches(hay, 'hybrid') then 'hybrid'
  when not regexp_matches(replace(hay, 'nationwide blvd', ''), 'remote|work from home|anywhere|nationwide') then 'onsite'
  when regexp_matches(hay, '\\b({_ABROAD})\\b') then 'remote_non_us'
  when regexp_matches(hay, '\\b({_OTHER})\\b|,\\s*({_OTHER_CODES})\\b') and not regexp_matches(hay, '\\btexas\\b|,\\s*tx\\b') then 'remote_restricted'
  when residue <> '' and not regexp_matches(hay, '\\bunited states\\b|\\bu\\.?s\\.?a\\.?\\b|\\bus\\b|\\b({_STATES_RE})\\b|,\\s*({_OTHER_CODES}|tx)\\b|\\bremote[\\s-]*({_OTHER_CODES}|tx)\\b') then 'remote_non_us' else 'remote_us' end as scope from r)"""


@query(
    f"with {_LOC} select c_custkey, scope, case when regexp_matches(location, '(?i)\\b({_CITY})\\b') and not regexp_matches(location, '(?i)\\b({_OTHER})\\b|,\\s*({_OTHER_CODES})\\b') then 'dfw' when scope = 'remote_us' then 'remote_us' end as location_match from s"
)
def location_match(spark, d):
    p = _places(spark, d)
    return p.select("c_custkey", matching.remote_scope(F.col("location"), F.col("title"), F.lit(None).cast("boolean")).alias("scope"), matching.location_match(F.col("location"), F.col("title"), F.lit(None).cast("boolean")).alias("location_match"))


_NOW = "2024-01-31 00:00:00"


@query(
    f"""with e as (select event_id, case when event_id % 5 <> 0 then ts end as posted, case when event_id % 7 <> 0 then ts + interval 1 day end as seen from events), x as (select *, coalesce(posted, seen) as dt from e)
    select event_id, case when dt is null then 'date_unavailable' when dt >= timestamp '{_NOW}' - interval 168 hour then 'within_window' else 'older_than_window' end as status, case when posted is not null then 'posted' when seen is not null then 'first_seen' else 'none' end as date_source from x"""
)
def freshness(spark, d):
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp")).alias("posted"), F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("timestamp") + F.expr("interval 1 day")).alias("seen"))
    status, source = dates.freshness(F.col("posted"), F.col("seen"), F.lit(_NOW).cast("timestamp"))
    return e.select("event_id", status.alias("status"), source.alias("date_source"))


@query(f"""select event_id, case event_id % 3 when 0 then case when epoch(ts) - epoch(timestamp '{_NOW}') <= 172800 then ts end when 1 then timestamp '{_NOW}' - interval 1 day * (event_id % 30) else timestamp '{_NOW}' end as parsed from (select event_id, date_trunc('second', ts) as ts from events)""")
def parse_date(spark, d):
    """Written dates, relative phrases and "today" made from the events."""
    e = _t(spark, d, "events")
    phrase = (
        F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit("Posted "), (F.col("event_id") % 30).cast("string"), F.lit(" Days Ago")))
        .otherwise("Posted Today")
    )
    return e.select("event_id", dates.parse(phrase, F.lit(_NOW).cast("timestamp")).cast("timestamp_ntz").alias("parsed"))


@query(
    """select o_orderkey, o_custkey, o_orderdate from orders where o_custkey % 3 = 0 and o_orderstatus in ('O', 'F') and (o_orderdate is null or (o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01'))"""
)
def export_filter(spark, d):
    o = _t(spark, d, "orders").withColumns({"company": (F.col("o_custkey") % 3).cast("string"), "title": F.col("o_orderpriority"), "change_status": F.col("o_orderstatus")})
    day = lambda x: F.lit(x).cast("timestamp_ntz")
    return report.export_filter(o, ["0"], "", ["O", "F"], day("1996-01-01"), day("1997-12-31"), "o_orderdate").select("o_orderkey", "o_custkey", "o_orderdate")


# ---------------------------------------------------------------- copies, runs, stores

_LINES = "select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as seq from lineitem"


def _lines(spark, d):
    """lineitem with an arrival order: by order, then its lines; no global window."""
    li = _t(spark, d, "lineitem")
    cols = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    nth = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*cols))
    return li.withColumn("seq", F.col("l_orderkey") * 10000 + nth)


@query(
    f"""with t0 as ({_LINES}), t as (select *, l_orderkey * 10000 + row_number() over (partition by l_orderkey order by seq) as s2 from t0),
    w as (select *, row_number() over (partition by l_orderkey, l_partkey order by (l_returnflag = 'A') desc, (l_linestatus = 'F') desc, l_discount desc, s2) as rn, min(s2) over (partition by l_orderkey, l_partkey) as pos from t),
    u as (select * from w where rn = 1),
    x as (select *, row_number() over (partition by l_orderkey, l_linenumber order by (l_returnflag = 'A') desc, (l_linestatus = 'F') desc, l_discount desc, pos) as rn2, min(pos) over (partition by l_orderkey, l_linenumber) as pos2 from u)
    select l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, l_discount, pos2 as place from x where rn2 = 1"""
)
def dedup_two_passes(spark, d):
    q = [(F.col("l_returnflag") == "A").cast("int"), (F.col("l_linestatus") == "F").cast("int"), F.col("l_discount")]
    key = lambda *c: F.concat_ws("/", *[F.col(x).cast("string") for x in c])
    rows = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_discount", "seq")
    out = dedup.two_passes(rows, key("l_orderkey", "l_partkey"), key("l_orderkey", "l_linenumber"), F.lit(""), q)
    return out.withColumnRenamed("seq", "place")


_RUNS = """d as (select user_id, cast(ts as date) as run, event_type, event_id from events),
 r as (select user_id as company, run, count(*) as n, count(*) % 4 <> 0 as success, count(*) % 5 <> 0 as complete from d group by 1, 2),
 s as (select distinct user_id as company, run, event_type as job_id from d)"""


def _runs(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("company"), F.to_date("ts").alias("run"), F.col("event_type").alias("job_id"))
    runs = e.groupBy("company", "run").agg(F.count("*").alias("n")).withColumns({"success": F.col("n") % 4 != 0, "complete": F.col("n") % 5 != 0})
    return runs, e.distinct()


@query(
    f"""with {_RUNS}, a as (select *, lag(case when success then n else 0 end) over (partition by company order by run) as prev from r),
    b as (select *, case when success and n > 0 and complete and not coalesce(prev >= 20 and n < prev * 0.5, false) then 1 else 0 end as ql from a), q as (select *, sum(ql) over (partition by company order by run) as q from b),
    m as (select company, max(q) as mq from q group by 1), y as (select s.company, s.job_id, s.run, q.q, q.ql from s join q on s.company = q.company and s.run = q.run where success and n > 0),
    l as (select *, case when q - ql - lag(q) over (partition by company, job_id order by run) >= 2 then 1 else 0 end as brk from y), i as (select *, sum(brk) over (partition by company, job_id order by run) as island from l),
    g as (select company, job_id, island, min(run) as first_seen, max(run) as last_seen, max(q) as lq from i group by 1, 2, 3), k as (select *, row_number() over (partition by company, job_id order by island desc) as rn from g)
    select k.company, job_id, first_seen, last_seen, cast(mq - lq as integer) as misses from k join m on k.company = m.company where rn = 1 and mq - lq < 2"""
)
def lifecycle_history(spark, d):
    runs, seen = _runs(spark, d)
    return lifecycle.history(runs, seen)


@query(f"with {_RUNS}, a as (select *, lag(n) over (partition by company order by run) as prev from r) select company, run, n, coalesce(prev >= 20 and n < prev * 0.5, false) as collapsed, success and n > 0 and complete and not coalesce(prev >= 20 and n < prev * 0.5, false) as allowed from a")
def removal_gate(spark, d):
    runs, _ = _runs(spark, d)
    prev = F.lag("n").over(W.partitionBy("company").orderBy("run"))
    r = runs.withColumn("prev", prev)
    return r.select("company", "run", "n", lifecycle.collapsed(F.col("prev"), F.col("n")).alias("collapsed"), lifecycle.removal_allowed(F.col("success"), F.col("n"), F.col("complete"), F.col("prev")).alias("allowed"))


_CUT = "1998-01-01"


def _store(spark, d):
    """Orders before a day as the store, later ones and some earlier ones with changes as the batch."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.concat(F.lit("http://o/"), "o_orderkey").alias("job_url"), F.col("o_custkey").cast("string").alias("company"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("location"), F.col("o_orderdate").cast("timestamp").alias("date_posted"), F.col("o_orderkey").alias("seq"))
    old = lifecycle.with_hash(o.where(F.col("date_posted") < _CUT)).select("job_id", "job_url", "company", "title", "location", F.lit("2024-01-01").cast("timestamp").alias("first_seen"), F.lit("2024-01-01").cast("timestamp").alias("last_seen"), "date_posted", F.lit(1).alias("misses"), "record_hash", F.lit(None).cast("timestamp").alias("changed_at"), F.lit(None).cast("array<string>").alias("changed_fields"))
    new = o.where((F.col("date_posted") >= _CUT) | (F.col("seq") % 3 == 0)).withColumn("title", F.when(F.col("seq") % 2 == 0, F.concat("title", F.lit(" II"))).otherwise(F.col("title")))
    return old, new


@query(
    f"""with o as (select *, o_orderdate < timestamp '{_CUT}' as old, o_orderdate >= timestamp '{_CUT}' or o_orderkey % 3 = 0 as hit from orders)
    select cast(o_orderkey as varchar) as job_id, case when not hit then null when not old then 'new' when o_orderkey % 2 = 0 then 'changed' else 'unchanged' end as change,
    case when hit and o_orderkey % 2 = 0 then o_orderpriority || ' II' else o_orderpriority end as title, cast(case when hit then 0 else 1 end as integer) as misses,
    case when old then timestamp '2024-01-01' else timestamp '2024-02-01' end as first_seen, case when hit then timestamp '2024-02-01' else timestamp '2024-01-01' end as last_seen,
    case when hit and old and o_orderkey % 2 = 0 then 'title' end as changed_fields from o where old or hit"""
)
def upsert_store(spark, d):
    old, new = _store(spark, d)
    out = lifecycle.upsert(old, new, F.lit("2024-02-01").cast("timestamp"))
    return out.select("job_id", "change", "title", "misses", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), F.when(F.size("changed_fields") > 0, F.array_join("changed_fields", ",")).alias("changed_fields"))


@query(
    f"""with o as (select *, o_orderdate < timestamp '{_CUT}' as old, o_orderdate >= timestamp '{_CUT}' or o_orderkey % 3 = 0 as hit from orders where o_orderdate < timestamp '{_CUT}')
    select cast(o_orderkey as varchar) as job_id, cast(case when o_orderkey % 3 = 0 then 0 else 1 end as integer) as misses from o where o_orderkey % 3 = 0 or o_custkey % 2 = 1"""
)
def sync_store(spark, d):
    """Every second company may remove; what it no longer lists has its second miss."""
    old, new = _store(spark, d)
    allowed = old.where(F.col("company").cast("long") % 2 == 0).select("company").distinct()
    return lifecycle.sync(old, new.select("company", "job_id"), allowed).select("job_id", F.col("misses").cast("int").alias("misses"))


@query(
    f"""with o as (select *, o_orderdate < timestamp '{_CUT}' as old, (o_orderdate >= timestamp '{_CUT}' or o_orderkey % 3 = 0) and o_custkey % 10 = 0 as hit from orders)
    select cast(o_orderkey as varchar) as job_id, case when hit and o_orderkey % 2 = 0 then o_orderpriority || ' II' else o_orderpriority end as title, cast(case when hit then 0 else 1 end as integer) as misses, case when hit then 2 else 1 end as seen from o where old or hit"""
)
def bucketed_store(spark, d):
    """Every tenth company's batch upserted into a store in buckets, of which it touches a part."""
    old, new = _store(spark, d)
    store = BucketStore(spark, places.scratch(spark, "buckets"), S.STATE, buckets=64)
    store.commit(old)
    batch = new.where(F.col("company").cast("long") % 10 == 0)
    store.update(batch.select("company"), lambda s: lifecycle.upsert(s, batch, F.lit("2024-02-01").cast("timestamp")).drop("change"))
    return store.read().select("job_id", "title", "misses", F.month("last_seen").alias("seen"))


@query("""select event_id, cast(user_id as varchar) as job_id, event_type as kind from events e where not exists (select 1 from events s where s.event_type = 'purchase' and s.ts < timestamp '2024-01-15' and s.user_id = e.user_id and s.event_type = e.event_type)""")
def unannounced(spark, d):
    e = _t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("kind"), "ts")
    sent = e.where("kind = 'purchase'").where(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return lifecycle.unannounced(e.drop("ts"), sent).select("event_id", "job_id", "kind")


@query(
    """with k as (select user_id, min(ts) as first_seen from events where ts < timestamp '2024-01-10' group by 1)
    select event_id, k.first_seen, k.user_id is null as is_new, case when k.user_id is null then 'new' when event_type = 'purchase' then 'changed' else 'unchanged' end as change_status from events e left join k on e.user_id = k.user_id where e.ts >= timestamp '2024-01-10'"""
)
def first_seen_lookup(spark, d):
    e = _t(spark, d, "events")
    day = F.lit("2024-01-10").cast("timestamp_ntz")
    known = e.where(F.col("ts") < day).groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    now = e.where(F.col("ts") >= day).join(known, "user_id", "left")
    return now.select("event_id", "first_seen", F.col("first_seen").isNull().alias("is_new"), report.change_status(F.col("first_seen").isNull(), F.col("event_type") == "purchase").alias("change_status"))


@query(
    f"""with c as (select c_custkey as k, c_custkey % 4 <> 0 as success, c_custkey % 3 = 0 as auth from customer),
    p as (select *, max(seq) over (partition by id) as last from (select r.*, o_orderkey * 3 + n as seq, case when o_orderkey % 11 > 0 then o_orderkey end as id from (select * from orders where o_orderdate < timestamp '{_CUT}') r cross join range(3) as x(n) where n = 0 or o_orderkey % 7 = n) left join c on o_custkey = k where not coalesce(success and auth, false)),
    f as (select *, row_number() over (partition by id order by seq desc) as nth, 'fresh' || (seq - o_orderkey * 3) as origin from (select r.*, o_orderkey * 3 + n as seq, case when o_orderkey % 11 > 0 then o_orderkey end as id from (select * from orders where o_orderdate >= timestamp '{_CUT}' or o_orderkey % 5 = 0) r cross join range(3) as x(n) where n = 0 or o_orderkey % 3 = n) join c on o_custkey = k where success)
    select p.id as o_orderkey, p.o_custkey, coalesce(f.origin, 'old' || (p.seq - p.o_orderkey * 3)) as origin from p left join f on p.id = f.id and p.seq = p.last and f.nth = 1
    union all select id, o_custkey, origin from f where id is null or nth = 1 and id not in (select id from p where id is not null)"""
)
def merge_jobs(spark, d):
    """A retry into the last run, with ids that repeat on both sides, and rows without one."""
    n, k = F.col("n"), F.col("o_orderkey")
    o = _t(spark, d, "orders").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2))))
    o = o.select(k, F.when(k % 11 > 0, k).alias("job_id"), F.col("o_custkey").alias("company"), "o_orderdate", (k * 3 + n).alias("seq"), "n")
    day = F.lit(_CUT).cast("timestamp_ntz")
    p = o.where((F.col("o_orderdate") < day) & ((n == 0) | (k % 7 == n))).withColumn("origin", F.concat(F.lit("old"), n))
    f = o.where(((F.col("o_orderdate") >= day) | (k % 5 == 0)) & ((n == 0) | (k % 3 == n))).withColumn("origin", F.concat(F.lit("fresh"), n))
    told = _t(spark, d, "customer").select(F.col("c_custkey").alias("company"), (F.col("c_custkey") % 4 != 0).alias("success"), (F.col("c_custkey") % 3 == 0).alias("authoritative"))
    out = merge.merge_rows(p, f, told)
    return out.select(F.col("job_id").alias("o_orderkey"), F.col("company").alias("o_custkey"), "origin")


@query(
    f"""with p as (select o_custkey, count(*) as jobs, 'old' as run from orders where o_orderdate < timestamp '{_CUT}' group by 1), f as (select o_custkey, count(*) as jobs, 'new' as run from orders where o_orderdate >= timestamp '{_CUT}' group by 1)
    select * from f union all select * from p where o_custkey not in (select o_custkey from f)"""
)
def merge_reports(spark, d):
    o = _t(spark, d, "orders")
    day = F.lit(_CUT).cast("timestamp_ntz")
    part = lambda c, run: o.where(c).groupBy("o_custkey").agg(F.count("*").alias("jobs")).withColumn("run", F.lit(run))
    return merge.merge_report(part(F.col("o_orderdate") < day, "old"), part(F.col("o_orderdate") >= day, "new"), "o_custkey")


@query("select c_custkey, case when c_acctbal < 0 then coalesce(m, c_mktsegment) else c_mktsegment end as segment from customer left join (select o_custkey, max(o_orderpriority) as m from orders group by 1) on c_custkey = o_custkey")
def fill_blank(spark, d):
    """Write discovered values back only where a cell is blank (here: where the balance is negative)."""
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), "c_acctbal")
    found = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("segment"))
    return merge.fill_blank(c, found, "c_custkey", "segment", F.col("c_acctbal") < 0).select("c_custkey", "segment")


# ---------------------------------------------------------------- walks, reports

_PAGES = """n as (select l_suppkey as source, l_orderkey * 10 + l_linenumber % 10 as k, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as rn, count(*) over (partition by l_suppkey) as cnt, count(distinct l_orderkey * 10 + l_linenumber % 10) over (partition by l_suppkey) as dk from lineitem)"""


@query(
    f"""with {_PAGES}, p as (select source, cast(rn // 20 as integer) as page_no, count(*) as size, any_value(case when source % 3 = 0 then null else cnt end) as total, source % 7 = 0 and rn // 20 = 3 as failed, sha1(string_agg(cast(k as varchar), ',' order by rn)) as print from n group by source, rn // 20),
    ff as (select source, k, min(cast(rn // 20 as integer)) as page_no from n group by 1, 2), fr as (select source, page_no, count(*) as fresh from ff group by 1, 2),
    j as (select p.*, coalesce(fresh, 0) as fresh from p left join fr on p.source = fr.source and p.page_no = fr.page_no),
    x as (select *, max(total) over (partition by source) as known, sum(fresh) over (partition by source order by page_no) as got, first_value(size) over (partition by source order by page_no) as fs, row_number() over (partition by source, print order by page_no) as copy from j),
    y as (select *, case when failed then 'page_failed' when copy > 1 then 'repeated_page' when fresh = 0 then 'no_new_rows' when got >= known then 'reported_total_reached' when known is null and size < fs then 'exhausted' end as reason from x),
    z as (select source, min(case when reason is not null then page_no end) as stop from y group by 1), v as (select y.* from y join z on y.source = z.source where stop is null or page_no <= stop),
    a as (select source, count(*) filter (where not failed) as pages, sum(case when coalesce(reason in ('page_failed', 'repeated_page', 'no_new_rows'), false) then 0 else size end) as received, sum(case when coalesce(reason in ('page_failed', 'repeated_page', 'no_new_rows'), false) then 0 else fresh end) as collected, max(known) as total, coalesce(max_by(coalesce(reason, 'exhausted'), page_no), 'exhausted') as reason from v group by 1)
    select source, pages, cast(received as bigint) as received, cast(collected as bigint) as collected, total, case when reason = 'exhausted' and greatest(0, coalesce(total, 0) - collected) > greatest(1, floor(coalesce(total, 0) * 0.02)) then 'total_shortfall' else reason end as stop_reason,
    reason in ('exhausted', 'reported_total_reached') and not greatest(0, coalesce(total, 0) - collected) > greatest(1, floor(coalesce(total, 0) * 0.02)) as complete, cast(greatest(0, coalesce(total, 0) - collected) as bigint) as shortfall from a"""
)
def page_walk(spark, d):
    """Suppliers as sources, their lines as rows in pages of 20; some tell no total, some fail on page 3."""
    out = walk.walk(supplier_pages(spark, d), most=10**9, rows=_t(spark, d, "lineitem").count())
    return out.select("source", "pages", F.col("offset").alias("received"), "collected", "total", "stop_reason", "complete", "shortfall")


def supplier_pages(spark, d):
    """source, page_no, rows, total, failed of page_walk."""
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    by = W.partitionBy("l_suppkey")
    lines = _t(spark, d, "lineitem").select("l_suppkey", *cols)
    n = walk.dealt(lines, lines.count(), "l_suppkey").select(F.col("l_suppkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") % 10).alias("k"), (F.row_number().over(by.orderBy(*cols)) - 1).alias("rn"), F.count("*").over(by).alias("cnt"))
    n = n.withColumn("page_no", F.floor(F.col("rn") / 20).cast("int"))
    pages = n.groupBy("source", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "k"))), lambda x: x["k"]).alias("rows"), F.max(F.when(F.col("source") % 3 != 0, F.col("cnt"))).alias("total"))
    return pages.withColumn("failed", (F.col("source") % 7 == 0) & (F.col("page_no") == 3))


@query("select o_orderstatus, count(*) as n, count(distinct o_custkey) as companies, min(o_orderdate) as first_posted, max(o_orderdate) as last_posted from orders group by 1")
def status_counts(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("companies"), F.min("o_orderdate").alias("first_posted"), F.max("o_orderdate").alias("last_posted"))


_REPORT = """rep as (select o_custkey, count(*) as jobs, case when o_custkey % 11 = 0 then 'blocked' when o_custkey % 5 = 0 then 'failed' when count(*) < 5 then 'no_jobs' when o_custkey % 2 = 0 then 'success' else 'partial' end as status from orders group by 1)"""


def _report(spark, d):
    r = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("jobs"))
    status = report.company_status(F.col("o_custkey") % 11 == 0, F.col("o_custkey") % 5 != 0, F.when(F.col("jobs") < 5, 0).otherwise(F.col("jobs")), F.col("o_custkey") % 2 == 0)
    return r.withColumn("status", status)


@query(
    f"""with {_REPORT}, s as (select count(*) as companies, cast(sum(jobs) as bigint) as jobs, count(*) filter (where status in ('success', 'partial')) as successful, count(*) filter (where status = 'partial') as partial, count(*) filter (where status in ('failed', 'blocked')) as failed, count(*) filter (where status = 'blocked') as blocked from rep)
    select *, successful - partial as success_only, failed - blocked as failed_only, case when successful = 0 then 'failed' when partial > 0 or failed > 0 then 'partial' else 'completed' end as verdict from s"""
)
def run_summary(spark, d):
    r = _report(spark, d)
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    s = r.agg(F.count("*").alias("companies"), F.sum("jobs").alias("jobs"), n("success", "partial").alias("successful"), n("partial").alias("partial"), n("failed", "blocked").alias("failed"), n("blocked").alias("blocked"))
    return report.digest_counts(s).withColumn("verdict", report.verdict(F.col("successful"), F.col("partial"), F.col("failed")))


@query(f"with {_REPORT} select * from rep where status in ('partial', 'failed', 'blocked')")
def problem_rows(spark, d):
    return report.problems(_report(spark, d), "o_custkey")


@query(
    """with t as (select o_custkey as company, cast(substr(o_orderpriority, 1, 1) as integer) as tier, count(*) as n, max(o_orderkey) % 2 = 0 as complete from orders group by 1, 2),
    r as (select *, row_number() over (partition by company order by (n >= 10 and complete) desc, case when n >= 10 and complete then 0 else n end desc, tier) as rn from t) select company, tier, n as n_rows, complete from r where rn = 1"""
)
def best_cheap_tier(spark, d):
    t = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("company"), F.substring("o_orderpriority", 1, 1).cast("int").alias("tier")).agg(F.count("*").alias("rows"), (F.max("o_orderkey") % 2 == 0).alias("complete"))
    return report.best_tier(t).withColumnRenamed("rows", "n_rows")


@query("select user_id, min_by(event_type, (ts, event_id)) as term, count(*) as n from events group by 1")
def source_query(spark, d):
    return report.first_query(_t(spark, d, "events").withColumnRenamed("event_type", "term"), "user_id", "term", ["ts", "event_id"])


@query("select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k from events group by 1")
def recorded_json(spark, d):
    """Fields of recorded JSON by a declared schema."""
    e = _t(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query("select conv_id, count(*) as turns, max_by(text, turn) as last_text, count(*) filter (where role = 'user') as asked from (select conv_id, turn, role, max(text) as text from conversations group by 1, 2, 3) group by 1 having max(turn) is not null")
def progress(spark, d):
    """State of each conversation from its log: how many turns, and what was said last."""
    c = _t(spark, d, "conversations").groupBy("conv_id", "turn", "role").agg(F.max("text").alias("text"))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("text", "turn").alias("last_text"), F.count_if(F.col("role") == "user").alias("asked"), F.max("turn").alias("t")).where("t is not null").drop("t")


@query(
    """with s as (select c_custkey as k, 'http://c/' || c_custkey as entry, cast(c_custkey % 2 as integer) as fails, c_custkey % 3 = 0 as proven from customer),
    o as (select o_custkey as k, count(*) as jobs, case o_custkey % 5 when 0 then 'success' when 1 then 'clean_failure' when 2 then 'blocked' when 3 then 'transient' else 'low_yield' end as kind from orders group by 1),
    j as (select s.*, jobs, coalesce(kind, '') as kind from s left join o on s.k = o.k)
    select cast(k as varchar) as company, case when kind = 'clean_failure' then null else entry end as entry_url, case when kind = 'success' then jobs when kind = 'clean_failure' then null else 10 end as jobs_last_seen,
    cast(case when kind = 'success' then 0 when kind = 'clean_failure' then null when kind in ('transient', 'low_yield') then fails + 1 else fails end as integer) as consecutive_failures,
    case when kind = 'success' then true when kind = 'clean_failure' then null else proven end as proven, kind = 'clean_failure' as unsupported
    from j where not (kind = 'clean_failure' and proven) and not (kind in ('transient', 'low_yield') and fails + 1 >= 2)"""
)
def hint_step(spark, d):
    """Customers as remembered companies, their orders as what happened to them."""
    from ..operators import hints

    key = F.col("c_custkey")
    state = _t(spark, d, "customer").select(
        key.cast("string").alias("company"), F.concat(F.lit("http://c/"), key.cast("string")).alias("entry_url"), F.lit(None).cast("string").alias("json_endpoint"), F.lit("2024-01-01").cast("date").alias("verified_at"), F.lit(10).cast("long").alias("jobs_last_seen"), (key % 2).cast("int").alias("consecutive_failures"), (key % 3 == 0).alias("proven"), F.lit(False).alias("unsupported"), F.lit(None).cast("date").alias("checked_at")
    )
    kinds = F.array(*[F.lit(k) for k in ("success", "clean_failure", "blocked", "transient", "low_yield")])
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("jobs"))
    none = F.lit(None).cast("string")
    o = o.join(_t(spark, d, "customer"), F.col("o_custkey") == key, "left_semi")
    outcomes = o.select(F.col("o_custkey").cast("string").alias("company"), F.element_at(kinds, (F.col("o_custkey") % 5 + 1).cast("int")).alias("outcome"), none.alias("entry_url"), none.alias("json_endpoint"), "jobs", F.lit(True).alias("from_hint"))
    return hints.step(state, outcomes, F.lit("2024-02-01").cast("date")).select("company", "entry_url", "jobs_last_seen", "consecutive_failures", "proven", "unsupported")


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type order by event_id) as rn from events) where rn = 1 or event_type = 'view'")
def dedup_exact(spark, d):
    """The first event of each user and type; events without a type (here: views) are all kept."""
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("url"), F.col("event_id").alias("seq"))
    return dedup.first_of_each(e, ["user_id"], "url").select("event_id", "user_id", "event_type")


@query(
    r"""with a as (select page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="[^"]+"[^>]*>[^<]*</a>')) as x from pages), b as (select page_id, regexp_extract(x, 'href="([^"]+)"', 1) as href, trim(regexp_extract(x, '>([^<]*)</a>', 1)) as t from a)
    select page_id, count(distinct href) as n_links from b where length(t) >= 3 group by page_id"""
)
def page_links(spark, d):
    """Links of pages whose address has a hint (here: any path), each once."""
    from ..sources import pages

    return pages.job_links(_t(spark, d, "pages"), ("/",)).groupBy("page_id").agg(F.count("*").alias("n_links"))


from . import page_queries as page_queries  # noqa: E402  (they register themselves)
from . import run_queries as run_queries  # noqa: E402
from . import small_queries as small_queries  # noqa: E402
