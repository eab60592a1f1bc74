"""Text of records as Column functions. Patterns carry (?U): word and space classes follow Unicode."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes that differ between listings of one employer.
COMPANY_SUFFIXES = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "lp", "llp", "holdings", "group", "the")
# Wordings of remote and of part-time presence.
REMOTE_HINTS = ("remote", "work from home", "work-from-home", "wfh", "telecommute", "virtual", "anywhere", "home based", "home-based", "distributed")
HYBRID_HINTS = ("hybrid", "flex office", "flexible office")
# Spellings of "nothing".
BLANKS = ("", "nan", "none", "n/a", "na", "-", "null")


def literal(text: str) -> str:
    """A pattern that matches the text itself, for Java and RE2."""
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in text)


def any_of(words) -> str:
    return "|".join(literal(w) for w in words)


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML character references decoded; only texts with an ampersand go through Python."""
    return F.when(F.instr(c, "&") > 0, _unescape(c)).otherwise(c)


def squeeze(c: Column) -> Column:
    """White space runs to one space, trimmed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def clean(c: Column) -> Column:
    return squeeze(unescape(c))


def strip_html(c: Column, most: int = 5000) -> Column:
    text = clean(F.regexp_replace(c, "<[^>]+>", " "))
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("..."))).otherwise(text)


def token(c: Column) -> Column:
    """Lower case, punctuation to spaces, squeezed; null is empty."""
    return F.coalesce(squeeze(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " ")), F.lit(""))


def company_key(c: Column) -> Column:
    return F.array_join(F.filter(F.split(token(c), " "), lambda w: ~w.isin(*COMPANY_SUFFIXES)), " ")


def location_key(c: Column) -> Column:
    return F.coalesce(squeeze(F.regexp_replace(token(c), r"(?U)\b(united states|usa|us)\b", " ")), F.lit(""))


def join_location(*parts: Column, separator: str = ", ") -> Column:
    """Cleaned parts that are not empty, each once whatever its case; the first spelling stays."""
    kept = F.filter(F.array(*[clean(p) for p in parts]), lambda x: x.isNotNull())
    fresh = lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x))
    return F.nullif(F.array_join(F.aggregate(kept, F.array().cast("array<string>"), fresh), separator), F.lit(""))


def infer_remote(*parts: Column) -> Column:
    """False for hybrid wording, true for remote wording, null without either."""
    hay = F.lower(F.concat_ws(" ", *parts))
    return F.when(hay.rlike(any_of(HYBRID_HINTS)), False).when(hay.rlike(any_of(REMOTE_HINTS)), True)


def escape_formula(c: Column) -> Column:
    """What a spreadsheet would run as a formula gets a quote in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def is_blank(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*BLANKS)


def clean_label(c: Column) -> Column:
    """A location without its own label in front."""
    return F.trim(F.regexp_replace(c, r"(?iU)^\s*(?:job\s+)?locations?\s*[:\-]?\s*", ""))


def humanize(seconds: Column) -> Column:
    """45 seconds, 12 minutes, 1h 04m; less than none is none."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    few = F.concat(s.cast("string"), F.when(s == 1, " second").otherwise(" seconds"))
    m = F.floor(s / 60)
    some = F.concat(m.cast("string"), F.when(m == 1, " minute").otherwise(" minutes"))
    return F.when(s < 60, few).when(s < 3600, some).otherwise(F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def age(moment: Column, now: Column) -> Column:
    """12 minutes ago; empty without a moment, and just now for one ahead."""
    seconds = (F.unix_micros(now) - F.unix_micros(moment)) / 1_000_000
    return F.when(moment.isNull(), "").when(seconds < 0, "just now").otherwise(F.concat(humanize(F.floor(seconds)), F.lit(" ago")))


# Link texts that are navigation, whole and in part.
NAV = ("apply", "apply now", "view job", "details", "job details", "learn more", "read more", "next", "previous", "back", "search", "save job", "share", "sign in", "login", "home", "view all jobs", "see all jobs", "more", "all jobs", "browse jobs", "job search")
NAV_PARTS = (
    "join our", "join the", "search career", "search job", "search open", "view open", "view opportunit", "view job", "browse job", "explore job", "explore opportunit", "current employee", "hiring event", "job alert",
    "create profile", "create account", "sign up", "talent network", "talent community", "life at", "why work", "our culture", "benefits", "meet our", "learn about", "see open", "find your", "start your",
    "all locations", "all departments", "view all", "see all", "show all", "career website", "career site", "jobs by", "job openings", "saved job", "view more", "load more", "show more", "our jobs", "job categor",
    "search our", "back to", "go to", "read our", "follow us",
)


def is_navigation(title: Column) -> Column:
    low = F.lower(F.trim(title))
    shouted = (title == F.upper(title)) & (title != F.lower(title)) & (F.size(F.split(F.trim(title), r"(?U)\s+")) <= 3)
    return low.isin(*NAV) | low.rlike(any_of(NAV_PARTS)) | shouted


def is_posting_link(title: Column, href: Column) -> Column:
    """A link text of a posting's length that is no navigation, to a page or a routed fragment."""
    n = F.length(F.trim(title))
    away = href.rlike("^(javascript:|mailto:|tel:)") | (href.startswith("#") & ~F.substring(href, 2, 1 << 30).contains("/"))
    return F.coalesce((n >= 6) & (n <= 250) & ~is_navigation(title) & (href != "") & ~away, F.lit(False))


def place_of_bullets(bullets: Column, path: Column) -> Column:
    """The bullets that are no requisition id: not the id that the path ends with, nor shaped like one."""
    own = F.when(path.contains("_"), F.regexp_extract(path, "_([^_]*)$", 1)).otherwise("")
    stays = lambda b: (b != "") & ~((own != "") & (b.startswith(own) | own.startswith(b))) & ~b.rlike(r"^[A-Za-z]{0,6}[-_]?\d[\d\-_]*$")
    return F.nullif(F.array_join(F.array_distinct(F.filter(F.transform(bullets, lambda b: F.trim(b)), stays)), ", "), F.lit(""))
