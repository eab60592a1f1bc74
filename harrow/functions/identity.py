"""Identities that last: of postings, of record contents, of runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, urls

# Query parameters that name a posting, in order of preference.
ID_KEYS = ("jobid", "reqid", "requisitionid", "jobseqno", "opportunityid", "job", "id", "key", "params", "gh_jid")
WORKDAY_ID = r"_([Rr]\d+(?:-\d+)?)(?:/|$)"
UUID = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})/?$"
#: Providers whose ids are the last path segment's number or uuid.
BY_SEGMENT = ("greenhouse", "lever", "ashby", "smartrecruiters")
UNIT = "\x1f"


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def segment_id(url: Column) -> Column:
    last = F.element_at(F.filter(F.split(urls.part(url, 3), "/"), lambda s: s != ""), -1)
    return F.coalesce(_found(last, UUID), _found(last, r"(\d{4,})/?$"))


def query_id(url: Column) -> Column:
    pairs = urls.query_pairs(urls.part(url, 4))
    of = lambda key: F.try_element_at(F.filter(pairs, lambda p: F.lower(p["k"]) == key), F.lit(-1))["v"]
    return F.coalesce(*[of(k) for k in ID_KEYS])


def job_id(url: Column, provider: Column, company: Column) -> Column:
    """The company's key, then the best id that the URL holds, else the canonical URL; empty without a URL."""
    scope = F.coalesce(text.company_key(company), F.lit(""))
    prefix = F.when(scope != "", F.concat(scope, F.lit(":"))).otherwise("")
    p = F.lower(provider)
    own = F.when(p == "workday", _found(url, WORKDAY_ID)).when(p.isin(*BY_SEGMENT), segment_id(url))
    named = F.coalesce(F.concat(provider, F.lit(":"), own), F.concat(F.lit("workday:"), _found(url, WORKDAY_ID)), query_id(url), segment_id(url), urls.normalize(url), url)
    return F.when(url.isNull() | (url == ""), "").otherwise(F.concat(prefix, named))


def record_hash(*parts: Column) -> Column:
    """SHA-1 over the parts with a separator that text does not hold; null is empty."""
    return F.sha1(F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def notification_kind(changed: Column, digest: Column) -> Column:
    return F.when(changed, F.concat(F.lit("changed:"), F.substring(digest, 1, 12))).otherwise("new")


def stagger(key: Column, window: int) -> Column:
    """A steady offset in 0..window-1 from the first four bytes of SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(window))


def duplicate_key(company: Column, title: Column, location: Column, url: Column) -> Column:
    return F.concat_ws("|", text.company_key(company), text.token(title), text.location_key(location), F.coalesce(urls.normalize(url), F.lit("")))


def run_id(moment: Column) -> Column:
    """A sortable name of a run: when it began, in UTC (the session's time zone is UTC)."""
    return F.date_format(moment, "yyyyMMdd'T'HHmmss'Z'")


def parse_run_id(name: Column) -> Column:
    """When a run began, or null for what is no run's name."""
    t = F.trim(name)
    return F.when(t.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss'Z'")))
