"""Counts, orders and verdicts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..sinks import places
from . import hints, lifecycle

GOOD_ENOUGH = 10


def company_status(blocked: Column, success: Column, jobs: Column, complete: Column) -> Column:
    return F.when(blocked, "blocked").when(~success, "failed").when(jobs == 0, "no_jobs").when(complete, "success").otherwise("partial")


def counts(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def digest_counts(summary: DataFrame) -> DataFrame:
    """Counts that overlap (successful holds partial, failed holds blocked) as counts that do not."""
    return summary.withColumns({"success_only": F.col("successful") - F.col("partial"), "failed_only": F.col("failed") - F.col("blocked")})


def verdict(successful: Column, partial: Column, failed: Column) -> Column:
    return F.when(successful == 0, "failed").when((partial > 0) | (failed > 0), "partial").otherwise("completed")


def problems(report: DataFrame, seq: str = "seq") -> DataFrame:
    """Companies that need a look: partial, then failed, then blocked, in their order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in S.PROBLEMS]), F.col("status"))
    return report.where(F.col("status").isin(*S.PROBLEMS)).orderBy(rank, seq)


def change_status(is_new: Column, is_changed: Column) -> Column:
    return F.when(is_new, S.NEW).when(is_changed, S.CHANGED).otherwise(S.UNCHANGED)


def best_tier(tries: DataFrame, by: str = "company") -> DataFrame:
    """tries: tier (0 first), rows, complete. The first tier with enough rows and a complete walk,
    else the one with most rows, the earlier on a tie."""
    accepted = (F.col("rows") >= GOOD_ENOUGH) & F.col("complete")
    rank = F.struct(accepted.cast("int"), F.when(accepted, 0).otherwise(F.col("rows")), -F.col("tier"))
    return tries.groupBy(by).agg(F.max_by(F.struct("tier", "rows", "complete"), rank).alias("b")).select(by, "b.*")


def first_query(rows: DataFrame, url: str, term: str, order: list[str]) -> DataFrame:
    """Each URL with the first search term that surfaced it."""
    return rows.groupBy(url).agg(F.min_by(term, F.struct(*order)).alias(term), F.count("*").alias("n"))


def export_filter(df: DataFrame, companies: list[str] | None = None, title: str = "", statuses: list[str] | None = None, since=None, until=None, date: str = "date_posted") -> DataFrame:
    """All conditions together; the last day counts whole, and rows without a date always pass."""
    keep = F.lit(True)
    if companies:
        keep &= F.col("company").isin(*companies)
    if title:
        keep &= F.contains(F.lower("title"), F.lit(title.lower()))
    if statuses:
        keep &= F.col("change_status").isin(*statuses)
    if since is not None:
        keep &= F.col(date).isNull() | (F.col(date) >= since)
    if until is not None:
        keep &= F.col(date).isNull() | (F.col(date) < until + F.expr("interval 1 day"))
    return df.where(keep)


def busiest_path(urls: DataFrame, path: Column, query: Column, seq: str) -> DataFrame:
    """Paths asked with at least two different queries, with how many, and the first URL of each."""
    return urls.groupBy(path.alias("path")).agg(F.count_distinct(query).alias("n_queries"), F.min_by("url", seq).alias("url")).where("n_queries >= 2")


def nth(by: list[str], order: list[Column]) -> Column:
    return F.row_number().over(W.partitionBy(*by).orderBy(*order))


def with_previous(results: DataFrame, previous: DataFrame) -> DataFrame:
    """results with previous_jobs: how many postings the company had in the report before (company, jobs)."""
    p = previous.where("trim(company) != '' and jobs is not null").groupBy(F.trim("company").alias("company")).agg(F.max("jobs").alias("previous_jobs"))
    return results.join(p, "company", "left")


def stage_counts(rows: DataFrame) -> DataFrame:
    """How many rows each stage let through: collected, those of a wanted role, of these those in a wanted
    place, and of these those within, without a date, or older. Columns: role, place (booleans), status."""
    role = F.coalesce(F.col("role"), F.lit(False))
    placed = role & F.coalesce(F.col("place"), F.lit(False))
    at = lambda s: F.count_if(placed & (F.col("status") == s))
    return rows.agg(F.count("*").alias("collected"), F.count_if(role).alias("target_role"), F.count_if(placed).alias("location_match"), at(S.WITHIN).alias("within_window"), at(S.UNDATED).alias("date_unavailable"), at(S.OLDER).alias("older"))


def method_counts(results: DataFrame) -> DataFrame:
    """Companies by the method that served them, else by the planned one."""
    return counts(results.withColumn("method", F.coalesce("actual_method", "planned_method")), "method")


def provider_counts(results: DataFrame) -> DataFrame:
    """Companies by provider, the most common first."""
    return counts(results, "provider").orderBy(F.desc("n"), "provider")


def status_counts(results: DataFrame) -> DataFrame:
    return counts(results, "status")


def change_counts(jobs: DataFrame) -> DataFrame:
    """Exported rows by change status, whatever its case; blanks are nothing."""
    status = F.lower(F.trim(F.col("change_status").cast("string")))
    return counts(jobs.select(status.alias("change_status")).where("change_status not in ('', 'nan')"), "change_status")


def within_window(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.trim("date_filter_status") == S.WITHIN).alias("within_window"))


def cut_short(truncated: DataFrame) -> DataFrame:
    """One row about companies whose walk was cut (stop_reason): untrustworthy ones (the gap cannot be
    described), the distinct reasons, and whether all of them are describable."""
    some = F.coalesce(F.col("stop_reason"), F.lit("")) != ""
    told = F.array(*[F.lit(r) for r in hints.DESCRIBABLE])
    out = truncated.agg(F.count_if(some & ~F.col("stop_reason").isin(*hints.DESCRIBABLE)).alias("untrustworthy"), F.sort_array(F.collect_set(F.when(some, F.col("stop_reason")))).alias("stop_reasons"))
    return out.withColumn("describable", F.size(F.array_except("stop_reasons", told)) == 0)


def posted_bounds(jobs: DataFrame, date: str = "date_posted") -> DataFrame:
    return jobs.agg(F.min(date).alias("first_posted"), F.max(date).alias("last_posted"))


def distinct_companies(jobs: DataFrame) -> DataFrame:
    return jobs.where("company is not null").select("company").distinct().orderBy("company")


def workbook_counts(results: DataFrame) -> DataFrame:
    """company, jobs of the companies that succeeded, for the status columns of the workbook."""
    return results.where("success").groupBy("company").agg(F.max("jobs").alias("jobs"))


def costs(report: DataFrame) -> DataFrame:
    """company, timed_out, seconds of a report. Only a company's own limit counts as running out of time."""
    own = (F.col("error_type") == "Timeout") & F.contains(F.coalesce("error_message", F.lit("")), F.lit("per-company limit"))
    rows = report.where("trim(company) != ''").select(F.trim("company").alias("company"), F.coalesce(own, F.lit(False)).alias("timed_out"), F.coalesce(F.col("duration_seconds"), F.lit(0.0)).alias("seconds"))
    return rows.groupBy("company").agg(F.max("timed_out").alias("timed_out"), F.max("seconds").alias("seconds"))


def with_costs(plans: DataFrame, report: DataFrame) -> DataFrame:
    """Plans with what their company cost in the last run; nothing for the unknown."""
    return plans.join(costs(report), "company", "left").withColumns({"timed_out": F.coalesce("timed_out", F.lit(False)), "seconds": F.coalesce("seconds", F.lit(0.0))})


def truncated_order() -> list[Column]:
    """Cut walks by how much they miss; an untold total counts as nothing."""
    return [F.desc(F.coalesce("reported_total", F.lit(0)) - F.col("collected"))]


def collapsed_order() -> list[Column]:
    """Collapsed companies by how much they lost."""
    return [F.asc(F.col("collected") - F.col("previous"))]


def ranked(df: DataFrame, order: list[Column], seq: str, most: int | None = None) -> DataFrame:
    """df with rank, the place that an order gives it (ties by seq), or only the first `most`. Places are
    counted by range partitions and their prefix sums, so no task sees all rows. The sorted rows are
    written once: a second sort may cut its partitions elsewhere."""
    if most is not None:
        return df.orderBy(*order, F.asc(seq)).limit(most)
    df = df.orderBy(*order, F.asc(seq)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    at = places.scratch(df.sparkSession, "ranked")
    df.write.parquet(at)
    df = df.sparkSession.read.schema(df.schema).parquet(at)
    sizes = df.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return df.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at") % (1 << 33) + 1).drop("_part", "_at", "_before")


def prefer_cheap(tries: DataFrame) -> DataFrame:
    """Of a company's cheap harvest and its browser harvest (cheap_ and browser_ rows, complete, reason,
    total): the cheap one where it saw more and no provider was discovered. Completeness goes with the rows."""
    cheap = (F.col("cheap_rows") > F.col("browser_rows")) & F.col("discovered_provider").isNull()
    pick = lambda c: F.when(cheap, F.col(f"cheap_{c}")).otherwise(F.col(f"browser_{c}")).alias(c)
    total = F.when(cheap, F.coalesce("cheap_total", "browser_total")).otherwise(F.col("browser_total"))
    return tries.select("company", F.when(cheap, "cheap").otherwise("browser").alias("tier"), pick("rows"), pick("complete"), pick("reason"), total.alias("total"))
