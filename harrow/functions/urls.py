"""URLs as Column functions: canonical form, checks, parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id",
    "gh_src", "gclid", "fbclid", "msclkid", "mc_cid", "mc_eid",
    "src", "source", "ref", "referrer", "referral", "trackingid", "trk",
    "recruiter", "campaign", "cid", "sid", "iis", "iisn", "utm_referrer",
    "applyurl", "from", "jobposition", "cx_source",
)
#: scheme, host, path, query of a URL; splitting by pattern accepts what try_parse_url refuses.
PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, PARTS, i)


def decode(c: Column) -> Column:
    """Percent and plus decoding; what cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(c), c)


def encode(c: Column) -> Column:
    """Form encoding with ~ as itself and * encoded."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """array<struct<k, v>> of the pairs with a value."""
    raw = F.filter(F.split(query, "&"), lambda p: p.contains("="))
    pairs = F.transform(raw, lambda p: F.struct(decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), decode(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    return F.filter(pairs, lambda p: p["v"] != "")


def normalize(url: Column, drop_query: bool = False) -> Column:
    """Lower-case scheme and host, default ports, trailing slashes, tracking parameters and the
    fragment dropped, parameters sorted. Text without scheme or host comes back trimmed; blank is null."""
    text = F.nullif(F.trim(url), F.lit(""))
    host = F.regexp_replace(F.regexp_replace(F.lower(part(text, 2)), ":80$", ""), ":443$", "")
    path = F.regexp_replace(part(text, 3), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    kept = F.array_sort(F.filter(query_pairs(part(text, 4)), lambda p: ~F.lower(p["k"]).isin(*TRACKING)))
    query = F.lit("") if drop_query else F.array_join(F.transform(kept, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    whole = F.concat(F.lower(part(text, 1)), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(part(text, 1) == "", text).otherwise(whole)


def duplicate_form(url: Column) -> Column:
    """For comparing what people typed: https, no www., query kept."""
    n = normalize(url)
    return F.regexp_replace(n, r"^https?://(www\.)?", "https://")


def problem(url: Column) -> Column:
    """Why a URL cannot be used, or null."""
    host = F.regexp_replace(part(F.trim(url), 2), r":\d+$", "")
    return (
        F.when(url.isNull() | (F.trim(url) == ""), "empty")
        .when(F.trim(url).rlike(r"(?U)\s"), "contains white space")
        .when(~F.lower(part(F.trim(url), 1)).isin("http", "https"), "not http or https")
        .when(~host.contains("."), "no dotted host")
    )


def safe_to_fetch(url: Column) -> Column:
    """http(s), and not this machine or a private network."""
    host = F.lower(F.regexp_replace(part(url, 2), r"^.*@|:\d+$", ""))
    private = r"^(localhost|.*\.local|0\.0\.0\.0|127\..*|10\..*|192\.168\..*|169\.254\..*|172\.(1[6-9]|2\d|3[01])\..*|\[?::1\]?|\[?f[cd][0-9a-f]{2}:.*|\[?fe80:.*)$"
    return F.lower(part(url, 1)).isin("http", "https") & (host != "") & ~host.rlike(private)


def root_domain(url: Column) -> Column:
    """The last two labels of the host, three below a second-level suffix such as co.uk."""
    labels = F.split(F.lower(F.regexp_replace(part(url, 2), r":\d+$", "")), r"\.")
    three = (F.size(labels) > 2) & F.element_at(labels, -2).isin("co", "com", "org", "net", "gov", "ac")
    return F.array_join(F.when(F.size(labels) < 2, labels).when(three, F.slice(labels, -3, 3)).otherwise(F.slice(labels, -2, 2)), ".")


def detail(url: Column) -> Column:
    """The data address behind a public posting: host, tenant, site before "job" and all from there on."""
    host = part(url, 2)
    segments = F.filter(F.split(part(url, 3), "/"), lambda s: s != "")
    at = F.array_position(segments, "job")
    ok = F.contains(host, F.lit("myworkday")) & (at > 1)
    tail = F.array_join(F.slice(segments, F.greatest(at, F.lit(1)).cast("int"), F.size(segments)), "/")
    site = F.try_element_at(segments, F.greatest(at - 1, F.lit(1)).cast("int"))
    return F.when(ok, F.concat(F.lit("https://"), host, F.lit("/wday/cxs/"), F.split_part(host, F.lit("."), F.lit(1)), F.lit("/"), site, F.lit("/"), tail))


# First labels of hosts that may be left out.
STRIPPABLE = ("careers", "jobs", "www")


def other_hosts(host: Column) -> Column:
    """Hosts to try for a dead one, best first: without its first label, then www. and the root domain."""
    root = root_domain(F.concat(F.lit("https://"), host))
    rest = F.when(F.lower(F.split_part(host, F.lit("."), F.lit(1))).isin(*STRIPPABLE), F.regexp_replace(host, r"^[^.]*\.", ""))
    return F.filter(F.array_distinct(F.array_compact(F.array(rest, F.concat(F.lit("www."), root), root))), lambda h: (h != host) & (h != ""))


def safe_link(url: Column) -> Column:
    """A link that may stand in a page: http(s) or without a scheme, escaped; else empty."""
    t = F.trim(F.coalesce(url, F.lit("")))
    scheme = F.when(F.contains(t, F.lit(":")), F.lower(F.split_part(t, F.lit(":"), F.lit(1)))).otherwise("")
    out = t
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(scheme.isin("", "http", "https"), out).otherwise("")
