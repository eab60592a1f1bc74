"""Which vendor runs a careers page: by host, by what its markup mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text, urls

# Parts of hosts and the provider that each means, the first match wins.
HOSTS = (
    ("myworkdayjobs.com", "workday"), ("myworkdaysite.com", "workday"), ("wd1.myworkdayjobs", "workday"), ("workday.com", "workday"),
    ("greenhouse.io", "greenhouse"), ("boards.greenhouse", "greenhouse"), ("job-boards.greenhouse", "greenhouse"), ("lever.co", "lever"), ("ashbyhq.com", "ashby"),
    ("smartrecruiters.com", "smartrecruiters"), ("recruiting.paylocity.com", "paylocity"), ("paylocity.com", "paylocity"), ("ultipro.com", "ukg"), ("ukg.com", "ukg"), ("ukgpro.com", "ukg"), ("ukg.net", "ukg"),
    ("taleo.net", "taleo"), ("oraclecloud.com", "taleo"), ("taleo.com", "taleo"), ("icims.com", "icims"), ("phenompeople.com", "phenom"), ("phenom.com", "phenom"),
    ("successfactors.com", "successfactors"), ("successfactors.eu", "successfactors"), ("sapsf.com", "successfactors"), ("sapsf.eu", "successfactors"), ("avature.net", "avature"), ("eightfold.ai", "eightfold"),
    ("amazon.jobs", "amazon"), ("jobs.jobvite.com", "jobvite"), ("jobvite.com", "jobvite"), ("csod.com", "cornerstone"), ("jibeapply.com", "jibe"),
)
# What markup mentions, most telling first.
BODIES = (
    ("myworkdayjobs.com", "workday"), ("/wday/cxs/", "workday"), ("boards.greenhouse.io", "greenhouse"), ("job-boards.greenhouse.io", "greenhouse"), ("greenhouse.io/embed", "greenhouse"),
    ("api.lever.co", "lever"), ("jobs.lever.co", "lever"), ("jobs.ashbyhq.com", "ashby"), ("api.ashbyhq.com", "ashby"), ("api.smartrecruiters.com", "smartrecruiters"), ("jobs.smartrecruiters.com", "smartrecruiters"),
    ("recruiting.paylocity.com", "paylocity"), ("recruiting.ultipro.com", "ukg"), ("taleo.net", "taleo"), ("oraclecloud.com/hcmui", "taleo"), ("/hcmui/candidateexperience", "taleo"), (".icims.com", "icims"), ("icims_content_iframe", "icims"),
    ("app.eightfold.ai", "eightfold"), ("/api/apply/v2/jobs", "eightfold"), ("phenompeople.com", "phenom"), ("ph-widget", "phenom"), ("ddokey=refinesearch", "phenom"), ("phenomcdn", "phenom"), ("phapp.ddo", "phenom"), ("phapp=", "phenom"), ("data-ph-at-id", "phenom"), ("ph-page", "phenom"),
    ("successfactors.com", "successfactors"), ("sapsf.com", "successfactors"), ("avature.net", "avature"), ("avature.portal", "avature"), ("talentbrew.com", "radancy"), ("data-search-filters-module-name", "radancy"), ("data-search-results-module-name", "radancy"), ("radancy.net", "radancy"),
    ("amazon.jobs", "amazon"), ("jobs.jobvite.com", "jobvite"), ("jv-job-list", "jobvite"), (".csod.com", "cornerstone"), ("csod.context", "cornerstone"), ("jibeapply.com", "jibe"),
)


def _once(value: Column, make) -> Column:
    """make(value), where value is worked out once however often make reads it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _first(hay: Column, needles) -> Column:
    def told(h: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for part, provider in needles:
            out = out.when(F.contains(h, F.lit(part)), provider)
        return out

    return _once(hay, told)


def by_host(url: Column) -> Column:
    """The provider whose host this is, or null."""
    return _first(F.lower(urls.part(url, 2)), HOSTS)


def by_markup(html: Column, needles=BODIES) -> Column:
    return _first(F.lower(html), needles)


def coordinates(url: Column) -> Column:
    """struct<provider, host, tenant, site>: the tenant is the host's first label, or the first path
    segment where all tenants share a host; a Workday site is the first segment that is no language."""
    segments = F.filter(F.split(urls.part(url, 3), "/"), lambda s: s != "")
    parts = F.struct(by_host(url).alias("provider"), F.lower(urls.part(url, 2)).alias("host"), segments.alias("segments"))

    def told(p: Column) -> Column:
        provider, host, segments = p["provider"], p["host"], p["segments"]
        shared = provider.isin("greenhouse", "lever", "ashby", "smartrecruiters", "jobvite")
        site = F.try_element_at(F.filter(segments, lambda s: ~s.rlike("^[a-z]{2}(-[A-Za-z]{2})?$")), F.lit(1))
        tenant = F.when(shared, F.try_element_at(segments, F.lit(1))).when(provider.isNotNull(), F.split_part(host, F.lit("."), F.lit(1)))
        return F.struct(provider.alias("provider"), host.alias("host"), tenant.alias("tenant"), F.when(provider == "workday", site).alias("site"))

    return _once(parts, told)


# Addresses of job boards as pages embed them, and what is no board.
EMBEDDED = {
    "workday": r"https?://[\w.-]*\.wd\d+\.myworkday(?:jobs|site)\.com/[^\s\"'<>\\]+",
    "greenhouse": r"https?://(?:boards|job-boards)\.greenhouse\.io/[\w-]+",
    "lever": r"https?://jobs\.lever\.co/[\w-]+",
    "ashby": r"https?://jobs\.ashbyhq\.com/[\w-]+",
    "smartrecruiters": r"https?://(?:careers|jobs)\.smartrecruiters\.com/[\w-]+",
    "icims": r"https?://[\w.-]*\.icims\.com/[^\s\"'<>\\]*",
    "taleo": r"https?://[\w.-]*\.(?:taleo\.net|oraclecloud\.com)(?::\d+)?/[^\s\"'<>\\]*",
    "avature": r"https?://[\w.-]*\.avature\.net/[^\s\"'<>\\]*",
    "ukg": r"https?://(?:recruiting\.ultipro\.com|[\w.-]+\.ukg\.net)/[^\s\"'<>\\]*",
    "paylocity": r"https?://recruiting\.paylocity\.com/[^\s\"'<>\\]*",
    "successfactors": r"https?://[\w.-]*\.(?:successfactors|sapsf)\.(?:com|eu)/[^\s\"'<>\\]*",
    "eightfold": r"https?://[\w.-]*\.eightfold\.ai/[^\s\"'<>\\]*",
    "jobvite": r"https?://jobs\.jobvite\.com/[\w-]+",
    "jibe": r"https?://[\w.-]*\.jibeapply\.com/[^\s\"'<>\\]*",
    "cornerstone": r"https?://[\w.-]*\.csod\.com/[^\s\"'<>\\]*",
}
ASSETS = (".js", ".css", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".map", ".mp4", ".webp", ".pdf")
NOT_BOARDS = ("/legal/", "/privacy", "/terms", "/cookie", "/extlib/", "/static/", "/assets/", "/scripts/", "/styles/", "/login", "/signin", "/sign-in", "/logout", "/support", "/contact", "/accessibility", "/sitemap", "/favicon", "/analytics", "/gtm", "/policy")


def embedded(html: Column, provider: str) -> Column:
    """Distinct board addresses of a provider in a page's markup, in order, safe to fetch."""
    raw = F.regexp_extract_all(html, F.lit("(?i)" + EMBEDDED[provider]), F.lit(0))
    tidy = F.transform(raw, lambda u: F.regexp_replace(F.replace(u, F.lit("&amp;"), F.lit("&")), r"""["'),;>\\]+$""", ""))
    fit = lambda u: ~F.lower(u).rlike(text.any_of(NOT_BOARDS)) & ~F.lower(urls.part(u, 3)).rlike("(?:" + text.any_of(ASSETS) + ")$") & urls.safe_to_fetch(u)
    return F.array_distinct(F.filter(tidy, fit))


def boards(html: Column) -> Column:
    """array<struct<provider, url>>: the first board address of each provider, in the providers' order."""
    found = F.array(*[F.struct(F.lit(p).alias("provider"), F.try_element_at(embedded(html, p), F.lit(1)).alias("url")) for p in EMBEDDED])
    return F.filter(found, lambda b: b["url"].isNotNull())


def candidates(html: Column) -> Column:
    """Board addresses that a page reveals: of the provider that its markup mentions, where it mentions
    one with boards, else of every provider, each once."""
    told = by_markup(html)
    mine = lambda b: told.isNull() | ~told.isin(*EMBEDDED) | (b["provider"] == told)
    return F.array_distinct(F.transform(F.filter(boards(html), mine), lambda b: b["url"]))


def resolve(redirect: Column, html: Column) -> Column:
    """struct<provider, url>: where a redirect leads, else the first board that the page embeds, else what its markup mentions."""
    moved = F.when(by_host(redirect).isNotNull(), F.struct(by_host(redirect).alias("provider"), redirect.alias("url")))
    told = F.struct(F.coalesce(by_markup(html), F.lit("unknown")).alias("provider"), redirect.alias("url"))
    return F.coalesce(moved, F.try_element_at(boards(html), F.lit(1)), told)


#: Providers with a direct collector.
SUPPORTED = tuple(dict.fromkeys(p for _, p in HOSTS))


def plan_route(ats_url: Column, live_url: Column, resolved: Column, browser: bool = True) -> Column:
    """struct<url, source, provider, method, note>: the ATS address, else the live page. A supported
    provider by its address, or by what the page resolved to (struct<provider, url>, may be null), goes
    by API; else the browser does it, where there is one."""
    said = lambda c: F.when(~text.is_blank(c), F.trim(c))
    url = F.coalesce(said(ats_url), said(live_url))
    source = F.when(said(ats_url).isNotNull() | said(live_url).isNull(), "ats_url").otherwise("live_jobs_url")
    own = by_host(url)
    direct = own.isin(*SUPPORTED)
    led = ~F.coalesce(direct, F.lit(False)) & F.coalesce(resolved["provider"].isin(*SUPPORTED), F.lit(False))
    none = url.isNull()
    return F.struct(
        F.when(led & ~none, F.coalesce(resolved["url"], url)).otherwise(url).alias("url"),
        source.alias("source"),
        F.when(none, "unknown").when(direct, own).when(led, resolved["provider"]).otherwise("unknown").alias("provider"),
        F.when(none, "browser").when(direct | led, "api").otherwise("browser" if browser else "api").alias("method"),
        F.when(none, "no URL").when(direct | led | F.lit(browser), F.lit(None).cast("string")).otherwise("no browser, no direct collector").alias("note"),
    )


def agreed_tenant(hits: DataFrame, by: str, url: str, seq: str) -> DataFrame:
    """hits: addresses that a page asked for. Each page's provider (that of its first known address) and
    that address, where all its addresses of the provider name one tenant and site; others are left out."""
    known = hits.select(by, url, seq, coordinates(F.col(url)).alias("_c")).where("_c.provider is not null")
    # null tenants and sites are values here
    place = F.struct(F.coalesce("_c.tenant", F.lit("\0")), F.coalesce("_c.site", F.lit("\0")))
    each = known.groupBy(by, F.col("_c.provider").alias("provider")).agg(F.min(F.struct(seq, url)).alias("_f"), F.min(place).eqNullSafe(F.max(place)).alias("_one"))
    first = each.groupBy(by).agg(F.min_by(F.struct("provider", F.col(f"_f.{url}").alias("url"), "_one"), f"_f.{seq}").alias("_p"))
    return first.where("_p._one").select(by, "_p.provider", "_p.url")
