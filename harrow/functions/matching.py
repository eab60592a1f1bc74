"""Roles, places, ways of working and skills as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S
from .text import any_of, literal

# U.S. states and their codes.
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia",
    "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland",
    "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey",
    "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina",
    "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
}
# Wordings of remote work, of hybrid work, and of places outside the U.S.
REMOTE = ("remote", "work from home", "work-from-home", "wfh", "telecommute", "virtual", "anywhere in the us", "anywhere", "home based", "home-based", "us-remote", "remote - us", "nationwide", "distributed")
HYBRID = ("hybrid", "days onsite", "days on-site", "days in office", "days in-office", "flex office", "flexible office")
ABROAD = (
    "india", "canada", "mexico", "united kingdom", "uk", "ireland", "germany", "france", "spain", "poland", "romania", "netherlands", "singapore",
    "australia", "japan", "china", "brazil", "argentina", "philippines", "emea", "apac", "latam", "europe", "asia", "bengaluru", "bangalore",
    "hyderabad", "pune", "chennai", "mumbai", "noida", "gurgaon", "toronto", "vancouver", "london", "dublin", "berlin", "paris", "madrid", "warsaw",
)
# Street words; a remote word before one is a street's name.
STREETS = ("blvd", "boulevard", "st", "street", "ave", "avenue", "rd", "road", "dr", "drive", "way", "ln", "lane", "pkwy", "parkway", "ct", "court", "pl", "place", "plaza", "cir", "circle", "sq", "square", "ter", "terrace", "hwy", "highway", "ste", "suite", "bldg", "building", "tower", "center", "centre", "campus")
# The metro area's cities.
CITIES = (
    "dallas", "fort worth", "dfw", "dallas-fort worth", "dallas/fort worth", "irving", "las colinas", "addison", "coppell", "farmers branch", "garland", "mesquite", "richardson", "carrollton", "rowlett",
    "cedar hill", "desoto", "duncanville", "grand prairie", "lancaster", "balch springs", "plano", "frisco", "mckinney", "allen", "wylie", "prosper", "celina", "little elm", "the colony", "lewisville",
    "flower mound", "denton", "highland village", "arlington", "grapevine", "southlake", "westlake", "roanoke", "keller", "euless", "bedford", "hurst", "colleyville", "north richland hills", "mansfield",
    "haltom city", "watauga", "rockwall", "forney",
)
# Titles that are wanted, and those that are not.
INCLUDE = (r"\bdata\b", r"\bsnowflake\s+(engineer|developer)", r"\bdatabricks\s+(engineer|developer)", r"\betl\s+(developer|engineer)", r"\banalytics\s+engineer")
EXCLUDE = (
    r"\bdata\s+scientist", r"\bdata\s+science\b", r"\bmachine\s+learning\s+engineer", r"\bml\s+engineer", r"\b(intern|internship|co-?op)\b", r"\bdata\s*center", r"\bdata\s+entry\b",
    r"\banalyst\b", r"\banalysis\b", r"\bbusiness\s+intelligence\b", r"\bdata\s+steward", r"\bdata\s+governance\b", r"\bdata\s+architect\b", r"\bannotator\b", r"\baccounting\b",
    r"\bproduct\s+management\b", r"\bdata\s+products?\b", r"\b(manager|director|head\s+of)\b",
    r"^\s*(?:senior\s+|sr\.?\s+|global\s+|regional\s+|executive\s+)?(?:vice\s+president|svp|evp|vp)\b", r"\bmanaging\s+consultant\b",
)
# Skills and the wordings that name them.
SKILLS = {
    "python": (r"\bpython\b",), "sql": (r"\bsql\b",), "pyspark": (r"\bpy-?spark\b",), "spark": (r"\bspark\b",), "snowflake": (r"\bsnowflake\b",), "databricks": (r"\bdatabricks\b",),
    "aws": (r"\baws\b", r"\bamazon web services\b"), "azure": (r"\bazure\b",), "gcp": (r"\bgcp\b", r"\bgoogle cloud\b"), "kafka": (r"\bkafka\b",), "etl": (r"\betl\b", r"\belt\b"), "airflow": (r"\bairflow\b",), "dbt": (r"\bdbt\b",),
}
SEPARATORS = r"[,;|/\\–—]|\s+-\s+|\(|\)|\[|\]"
COUNTRY = r"\bunited states\b|\bu\.?s\.?a\.?\b|\bus\b"


def one_of(patterns) -> str:
    return "(?iU)" + "|".join(f"(?:{p})" for p in patterns)


def role(title: Column, include=INCLUDE, exclude=EXCLUDE) -> Column:
    """A wanted wording in a segment of the title or in all of it, and no unwanted one in all of it."""
    parts = F.array_append(F.split(title, "(?U)" + SEPARATORS), title)
    found = F.exists(parts, lambda s: F.trim(s).rlike(one_of(include)))
    return F.coalesce(found & ~title.rlike(one_of(exclude)), F.lit(False))


def remote_words(hay: Column) -> Column:
    """Some remote wording occurs more often than it does as a street's name."""
    tests = []
    for w in REMOTE:
        whole = (F.length(hay) - F.length(F.replace(hay, F.lit(w), F.lit("")))) / len(w)
        street = F.regexp_count(hay, F.lit(rf"(?iU)\b{literal(w)}\b[\s,.]*(?:{'|'.join(STREETS)})\b"))
        tests.append(whole > street)
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def state_pattern(codes, remote: bool = False) -> str:
    """A state by name, or by code after a comma (or, with remote, after that word)."""
    names, short = any_of(STATES[c] for c in codes), "|".join(codes)
    return rf"(?iU)\b(?:{names})\b|,\s*(?:{short})\b" + (rf"|\bremote[\s-]*(?:{short})\b" if remote else "")


def residue(location: Column) -> Column:
    """What a location says beside remote wording."""
    text = F.lower(location)
    for w in sorted(REMOTE, key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?U)\b{literal(w)}\b", " ")
    text = F.regexp_replace(text, r"(?U)[^\w\s]", " ")
    text = F.regexp_replace(text, r"(?U)\b(in|the|and|or|of|only|based|position|role|usa?)\b", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def remote_scope(location: Column, title: Column, remote: Column) -> Column:
    place = F.lower(F.coalesce(location, F.lit("")))
    hay = F.concat(place, F.lit(" "), F.lower(F.coalesce(title, F.lit(""))))
    others = [c for c in STATES if c != "tx"]
    at_home = hay.rlike(one_of([COUNTRY])) | hay.rlike(state_pattern(list(STATES), True))
    return (
        F.when(hay.rlike(any_of(HYBRID)), S.HYBRID)
        .when(~F.coalesce(remote, F.lit(False)) & ~remote_words(hay), S.ONSITE)
        .when(hay.rlike(rf"(?U)\b(?:{any_of(ABROAD)})\b"), S.NON_US)
        .when(hay.rlike(state_pattern(others)) & ~hay.rlike(state_pattern(["tx"])), S.RESTRICTED)
        .when((residue(place) != "") & ~at_home, S.NON_US)
        .otherwise(S.REMOTE_US)
    )


def in_metro(location: Column, cities=CITIES) -> Column:
    """A listed city, and no state but Texas anywhere in the text."""
    others = [c for c in STATES if c != "tx"]
    return F.coalesce(location.rlike(rf"(?iU)\b(?:{any_of(cities)})\b") & ~location.rlike(state_pattern(others)), F.lit(False))


def location_match(location: Column, title: Column, remote: Column) -> Column:
    """dfw, remote_us or null."""
    return F.when(in_metro(location), "dfw").when(remote_scope(location, title, remote) == S.REMOTE_US, "remote_us")


def fit(title: Column, description: Column, skills=SKILLS) -> Column:
    """struct<score, matched, explanation>; half points round to even. Each skill is looked for once:
    what follows reads the list of hits, as the argument of a lambda, instead of looking again."""
    text = F.lower(F.concat(F.trim(F.coalesce(title, F.lit(""))), F.lit("\n"), F.trim(description)))
    none = F.coalesce(F.trim(description), F.lit("")) == ""
    found = F.array_compact(F.array(*[F.when(text.rlike(one_of(ps)), F.lit(name)) for name, ps in skills.items()]))
    names = F.array(*[F.lit(n) for n in skills])

    def told(hits: Column) -> Column:
        missing = F.array_except(names, hits)
        less = F.when(F.size(missing) > 0, F.concat(F.lit("; no mention of "), F.array_join(F.slice(missing, 1, 4), ", "))).otherwise("")
        return F.struct(
            F.bround(100.0 * F.size(hits) / len(skills)).cast("int").alias("score"),
            hits.alias("matched"),
            F.when(F.size(hits) == 0, "no configured skills mentioned").otherwise(F.concat(F.lit("matched "), F.array_join(hits, ", "), less)).alias("explanation"),
        )

    empty = F.struct(F.lit(None).cast("int").alias("score"), F.array().cast("array<string>").alias("matched"), F.lit("no description available").alias("explanation"))
    return F.when(none, empty).otherwise(F.element_at(F.transform(F.array(found), told), 1))
