"""Rows of recorded vendor payloads to records: one declarative mapping a provider.

A mapping names, for each field of a record, what may hold it, best first; an empty string counts as
absent. A plain text is a JSON path; a tuple of a location is paths that are joined; a tuple of an
address is what comes before the value, its path, and what comes after. Payloads are parsed once to
VARIANT, and all else is a projection. Providers whose payloads stand in pages (MARKS of `markup`) take
the object found there as body; those without payloads are read by `markup.listed` and `vendor_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Where each provider's payloads hold the rows and the fields.
MAPPINGS: dict[str, dict] = {
    "workday": {"rows": "$.jobPostings", "title": ["title"], "location": ["locationsText", "locations"], "date": ["postedOn", "startDate", "postedOnDate"], "url": ["externalPath"], "type": ["timeType"], "description": ["jobDescription"]},
    "greenhouse": {"rows": "$.jobs", "title": ["title"], "location": ["location.name", "location"], "date": ["first_published", "updated_at"], "url": ["absolute_url"], "type": [], "description": ["content"]},
    "lever": {"rows": "$", "title": ["text"], "location": ["categories.location"], "date": ["createdAt"], "url": ["hostedUrl"], "type": ["categories.commitment"], "description": ["descriptionPlain", "description"]},
    "ashby": {"rows": "$.jobs", "title": ["title"], "location": ["location"], "date": ["publishedAt", "updatedAt"], "url": ["jobUrl"], "type": ["employmentType"], "description": ["descriptionPlain", "descriptionHtml"]},
    "smartrecruiters": {"rows": "$.content", "title": ["name"], "location": [("location.city", "location.region", "location.country")], "date": ["releasedDate", "createdOn"], "url": ["ref"], "type": ["typeOfEmployment.label"], "description": [], "remote": "location.remote"},
    "ukg": {"rows": "$.opportunities", "title": ["Title", "JobTitle"], "location": [("Locations[0].LocalizedDescription", "Locations[1].LocalizedDescription", "Locations[2].LocalizedDescription"), ("Locations[0].Address.City", "Locations[0].Address.State.Code", "Locations[0].Address.Country.Code")], "date": ["PostedDate", "CreatedDate"], "url": ["UrlJobPosting", "JobUrl", "Url"], "type": ["EmploymentType", "FullTime"], "description": ["Description"]},
    "taleo": {"rows": "$.items[0].requisitionList", "title": ["Title"], "location": ["PrimaryLocation", "Location"], "date": ["PostedDate", "PostingStartDate"], "url": [("hcmUI/CandidateExperience/en/sites/{site}/job/", "Id", ""), ("hcmUI/CandidateExperience/en/sites/{site}/job/", "RequisitionId", "")], "type": ["JobType", "WorkerType", "JobSchedule"], "description": ["ShortDescriptionStr"], "workplace": "WorkplaceType"},
    "taleo_legacy": {"rows": "$.requisitionList", "title": ["column[0]"], "location": ["column[1]"], "date": ["column[2]"], "url": [("careersection/{site}/jobdetail.ftl?job=", "jobId", ""), ("careersection/{site}/jobdetail.ftl?job=", "contestNo", "")], "type": [], "description": ["descriptionTeaser"]},
    "phenom": {"rows": "$.jobs", "title": ["title"], "location": ["cityStateCountry", "cityState", "location", "address", ("city", "state", "country")], "date": ["postedDate", "dateCreated"], "url": ["applyUrl", ("job/", "jobSeqNo", ""), ("job/", "jobId", "")], "type": ["type"], "description": ["descriptionTeaser"]},
    "phenom_page": {"rows": "$.eagerLoadRefineSearch.data.jobs", "like": "phenom"},
    "eightfold": {"rows": "$.positions", "title": ["name", "title"], "location": ["location", ("locations[0]", "locations[1]", "locations[2]")], "date": ["t_create", "t_update"], "url": ["canonicalPositionUrl", "positionUrl"], "type": ["type"], "description": ["job_description"]},
    "amazon": {"rows": "$.jobs", "title": ["title"], "location": ["normalized_location", ("city", "state", "country_code")], "date": ["posted_date"], "url": ["job_path"], "type": ["job_schedule_type"], "description": ["description"]},
    "cornerstone": {"rows": "$.data.requisitions", "title": ["displayJobTitle", "jobTitle"], "location": [("locations[0].city", "locations[0].state", "locations[0].country")], "date": ["postingEffectiveDate"], "url": [("ux/ats/careersite/{site}/job/", "requisitionId", "?c={corp}")], "type": [], "description": []},
    "jibe": {"rows": "$.jobs", "title": ["data.title"], "location": ["data.full_location", ("data.city", "data.state", "data.country")], "date": ["data.posted_date", "data.update_date", "data.create_date"], "url": ["data.slug", "data.req_id"], "type": ["data.employment_type"], "description": ["data.description"]},
    "paylocity": {"rows": "$.jobs", "title": ["title", "jobTitle"], "location": ["location", "locationName"], "date": ["publishedDate", "postedDate"], "url": ["url", ("recruiting/jobs/Details/", "jobId", ""), ("recruiting/jobs/Details/", "id", "")], "type": ["employmentType", "jobType"], "description": ["description"]},
    "paylocity_page": {"rows": "$.Jobs", "title": ["JobTitle", "Title"], "location": [("JobLocation.City", "JobLocation.State"), ("Location.City", "Location.State"), "LocationName", "locationName"], "date": ["PublishedDate", "publishedDate"], "url": [("Recruiting/Jobs/Details/", "JobId", ""), ("Recruiting/Jobs/Details/", "jobId", "")], "type": ["EmploymentType", "JobType"], "description": ["Description"], "remote": "IsRemote"},
}
MAPPINGS["phenom_page"] |= {k: v for k, v in MAPPINGS["phenom"].items() if k != "rows"}


def value(row: Column, path: str) -> Column:
    return F.nullif(F.trim(F.try_variant_get(row, f"$.{path}", "string")), F.lit(""))


def first(row: Column, tries: list) -> Column:
    """The first path, or joined paths, with a text that is not empty. An object or a list is no text."""
    said = lambda t: text.join_location(*[value(row, p) for p in t]) if isinstance(t, tuple) else F.when(~F.substring(value(row, t), 1, 1).isin("{", "["), value(row, t))
    return F.coalesce(*[said(t) for t in tries]) if tries else F.lit(None).cast("string")


def address(row: Column, base: Column, tries: list, site: Column, corp: Column) -> Column:
    """The first address that the row gives, whole ones as they are, others below base."""
    root = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    found = []
    for t in tries:
        if isinstance(t, tuple):
            fill = lambda part: F.replace(F.replace(F.lit(part), F.lit("{site}"), F.coalesce(site, F.lit(""))), F.lit("{corp}"), F.coalesce(corp, F.lit("")))
            found.append(F.concat(root, fill(t[0]), value(row, t[1]), fill(t[2])))
        else:
            link = value(row, t)
            below = F.concat(root, F.regexp_replace(link, "^/+", ""))
            # where ids follow, only a whole address counts as one
            found.append(F.when(link.rlike("^https?://"), link).otherwise(F.lit(None).cast("string") if any(isinstance(x, tuple) for x in tries) else below))
    return F.coalesce(*found)


def records(payloads: DataFrame, provider: str) -> DataFrame:
    """payloads: company, base (URL), body (JSON text) and, for providers that need them, site and corp. One
    record a row of the payload; rows without a title or an address are dropped, bodies that do not
    parse give none."""
    m = MAPPINGS[provider]
    more = {c: F.col(c) if c in payloads.columns else F.lit(None).cast("string") for c in ("site", "corp")}
    rows = payloads.select("company", "base", *[v.alias(c) for c, v in more.items()], F.try_parse_json("body").alias("v")).where("v is not null")
    rows = rows.select("company", "base", "site", "corp", F.explode(F.try_variant_get("v", m["rows"], "array<variant>")).alias("row"))
    row = F.col("row")
    location = text.clean(first(row, m["location"]))
    if provider == "workday":
        bullets = F.coalesce(F.try_variant_get(row, "$.bulletFields", "array<string>"), F.array().cast("array<string>"))
        location = F.coalesce(location, text.place_of_bullets(bullets, F.coalesce(value(row, "externalPath"), F.lit(""))))
    if provider.startswith("phenom"):
        several = F.transform(F.slice(F.try_variant_get(row, "$.multi_location_array", "array<variant>"), 1, 6), lambda x: F.coalesce(value(x, "city"), F.try_variant_get(x, "$", "string")))
        location = F.coalesce(F.when(F.size(several) > 1, F.nullif(F.array_join(F.array_distinct(F.filter(several, lambda x: x != "")), " | "), F.lit(""))), location)
    said = F.lit(None).cast("boolean")
    if "remote" in m:
        said = F.try_variant_get(row, f"$.{m['remote']}", "boolean")
    if "workplace" in m:
        said = F.contains(F.lower(value(row, m["workplace"])), F.lit("remote"))
    out = rows.select(
        "company",
        text.clean(first(row, m["title"])).alias("title"),
        location.alias("location"),
        first(row, m["date"]).alias("date_text"),
        address(row, F.col("base"), m["url"], F.col("site"), F.col("corp")).alias("job_url"),
        text.clean(first(row, m["type"])).alias("employment_type"),
        text.strip_html(first(row, m["description"])).alias("description"),
        F.lit(provider.split("_")[0]).alias("ats_provider"),
        said.alias("_said"),
    )
    remote = F.coalesce("_said", text.infer_remote(F.col("location"), F.col("title")))
    return out.withColumn("remote", remote).drop("_said").where("title is not null and job_url is not null")


def payload(provider: str, fields: dict[str, Column]) -> Column:
    """A row of a provider's payload that holds these fields where its mapping looks first, as a struct: the
    way back, for fixtures."""
    m, tree = MAPPINGS[provider], {}
    for name, column in fields.items():
        tries = m[name]
        if tries:
            t = tries[0]
            path = t if isinstance(t, str) else t[1] if name == "url" else t[0]
            at, keys = tree, path.replace("[0]", ".[]").split(".")
            if "[" in keys[-1] and keys[-1] != "[]":  # a further place of a list
                key, i = keys[-1][:-1].split("[")
                tree.setdefault(key, {})[int(i)] = column
                continue
            for k in keys[:-1]:
                at = at.setdefault(k, {})
            at[keys[-1]] = column
    return _struct(tree)


def _struct(tree) -> Column:
    if isinstance(tree, Column):
        return tree
    if set(tree) == {"[]"}:
        return F.array(_struct(tree["[]"]))
    if "[]" in tree or any(isinstance(k, int) for k in tree):
        return F.array(*[_struct(tree[k]) for k in sorted(tree, key=lambda k: 0 if k == "[]" else k)])
    return F.struct(*[_struct(v).alias(k) for k, v in tree.items()])


def wrap(provider: str, rows: Column) -> Column:
    """A whole payload around an array of rows, as JSON text."""
    out = rows
    for key in reversed(MAPPINGS[provider]["rows"].removeprefix("$").lstrip(".").replace("[0]", ".[]").split(".")):
        if key:
            out = F.array(out) if key == "[]" else F.struct(out.alias(key))
    return F.to_json(out)
