"""Row filters that are small, and write-backs to the table of companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

RETRY = ("failed", "partial")


def company_contains(df: DataFrame, needle: str) -> DataFrame:
    """The needle is taken literally, whatever its case."""
    return df.where(F.contains(F.lower("company"), F.lit(needle.lower())))


def company_named(df: DataFrame, names: DataFrame) -> DataFrame:
    """names: company. Membership whatever the case, as a semi join."""
    return df.withColumn("_n", F.lower(F.trim("company"))).join(names.select(F.lower(F.trim("company")).alias("_n")), "_n", "left_semi").drop("_n")


def provider_is(plans: DataFrame, provider: str) -> DataFrame:
    return plans.where(F.col("provider") == provider)


def needs_detail(provider: Column, location: Column) -> Column:
    """A posting whose place is missing or only counted."""
    return (provider == "workday") & (F.coalesce(location, F.lit("")) == "") | (provider == "workday") & location.rlike(r"(?i)^\s*\d+\s+locations?\s*$")


def storable(job_id: Column, url: Column) -> Column:
    return F.coalesce((job_id != "") & (url != ""), F.lit(False))


def retryable(report: DataFrame, seq: str = "seq") -> DataFrame:
    """Companies to try again, each once, in the order of the report."""
    return report.where(F.col("status").isin(*RETRY)).groupBy("company").agg(F.min(seq).alias(seq)).orderBy(seq)


def companies(raw: DataFrame, company: str, ats_url: str, live_url: str) -> DataFrame:
    """The three columns of a workbook, trimmed, without rows that name nobody. Missing columns are an error that names them."""
    missing = [c for c in (company, ats_url, live_url) if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    cell = lambda c, n: F.trim(F.col(c).cast("string")).alias(n)
    out = raw.select(cell(company, "company"), cell(ats_url, "ats_url"), cell(live_url, "live_jobs_url"))
    return out.where(~F.lower(F.coalesce("company", F.lit(""))).isin("", "nan"))


def write_status(table: DataFrame, counts: DataFrame) -> DataFrame:
    """counts: company, jobs of the companies that were visited. Visited rows say TRUE or FALSE and how many; others stay."""
    c = counts.groupBy("company").agg(F.max("jobs").alias("_jobs"))
    seen = F.col("_jobs").isNotNull()
    out = table.join(c, "company", "left")
    return out.withColumns({"status": F.when(seen, F.when(F.col("_jobs") > 0, "TRUE").otherwise("FALSE")).otherwise(F.col("status")), "count": F.when(seen, F.col("_jobs")).otherwise(F.col("count"))}).drop("_jobs")


def suggest(table: DataFrame, found: DataFrame, apply: bool = False) -> DataFrame:
    """found: company, url (null: looked for in vain). Blank suggestions are filled, NOT FOUND where the
    search failed; with apply, a row whose status is FALSE also takes the URL as its own."""
    f = found.groupBy("company").agg(F.max("url").alias("_url"), F.lit(True).alias("_tried"))
    out = table.join(f, "company", "left")
    told = F.coalesce("_url", F.lit("NOT FOUND"))
    out = out.withColumn("suggestion", F.when(F.col("_tried") & text.is_blank(F.col("suggestion")), told).otherwise(F.col("suggestion")))
    if apply:
        out = out.withColumn("ats_url", F.when((F.col("status") == "FALSE") & F.col("_url").isNotNull(), F.col("_url")).otherwise(F.col("ats_url")))
    return out.drop("_url", "_tried")


def duplicates(table: DataFrame, name: str, url: Column, columns: tuple[str, ...] = ("ats_url", "live_jobs_url")) -> DataFrame:
    """Rows of the table that a proposed name or URL repeats, with which of the two it was."""
    from ..functions import urls

    same_name = F.lower(F.trim("company")) == name.strip().lower()
    same_url = F.lit(False)
    for c in columns:
        same_url = same_url | F.coalesce(urls.duplicate_form(F.col(c)) == urls.duplicate_form(url), F.lit(False))
    return table.withColumns({"same_name": F.coalesce(same_name, F.lit(False)), "same_url": same_url}).where("same_name or same_url")
