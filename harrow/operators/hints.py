"""Remembered entry points of companies: one step of their state, and when a digest may go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, identity

MAX_FAILURES, YIELD, MAX_AGE_DAYS, STAGGER_DAYS, UNKNOWN_LIMIT = 2, 0.8, 14, 7, 3
#: Ends of a walk whose gap can be described: the oldest rows are what is missing.
DESCRIBABLE = ("budget_exhausted", "page_ceiling", "more_results_available", "freshness_reached")
STATE = "company string, entry_url string, json_endpoint string, verified_at date, jobs_last_seen long, consecutive_failures int, proven boolean, unsupported boolean, checked_at date"


def usable(today: Column) -> Column:
    """Whether a remembered entry saves the discovery this time."""
    stamp = F.coalesce("verified_at", "checked_at")
    old = dates.expired(stamp, today, MAX_AGE_DAYS, identity.stagger(F.col("company"), STAGGER_DAYS))
    return ~old & ~F.coalesce("unsupported", F.lit(False)) & (F.coalesce("entry_url", "json_endpoint", F.lit("")) != "")


def least_rows(last: Column) -> Column:
    """Rows that an attempt must return to be believed."""
    return F.when(F.coalesce(last, F.lit(0)) <= 0, 1).otherwise(F.greatest(F.lit(1), F.floor(last * YIELD))).cast("long")


def step(state: DataFrame, outcomes: DataFrame, today: Column) -> DataFrame:
    """The store after one run. outcomes: company, outcome (success, clean_failure, blocked,
    transient, low_yield), entry_url, json_endpoint, jobs, from_hint; one row a company at most.

    Success stores what served the company. A clean failure forgets a proven entry, and marks one that
    never served as unsupported; blocks say nothing; other failures count, and the second in a row forgets."""
    s = state.select(F.col("company").alias("sc"), F.struct(*[c for c in state.columns if c != "company"]).alias("s"))
    o = outcomes.select(F.col("company").alias("oc"), F.struct(*[c for c in outcomes.columns if c != "company"]).alias("o"))
    j = s.join(o, F.col("sc") == F.col("oc"), "full")
    known, kind = F.col("sc").isNotNull(), F.col("o.outcome")
    failures = F.coalesce("s.consecutive_failures", F.lit(0)) + 1
    won = kind == "success"
    clean, counted = known & (kind == "clean_failure"), known & kind.isin("transient", "low_yield")
    proven = F.coalesce("s.proven", F.lit(False))
    entry, endpoint = F.coalesce("o.entry_url", "s.entry_url"), F.coalesce("o.json_endpoint", "s.json_endpoint")
    gone = (clean & proven) | (counted & (failures >= MAX_FAILURES)) | (~known & ~won) | (won & (F.coalesce(entry, endpoint, F.lit("")) == "") & ~known)
    mark = clean & ~proven
    none = lambda t: F.lit(None).cast(t)
    pick = lambda good, t, old: F.when(won, good).when(mark, none(t)).otherwise(F.col(old))
    return j.where(~F.coalesce(gone, F.lit(False))).select(
        F.coalesce("sc", "oc").alias("company"),
        pick(entry, "string", "s.entry_url").alias("entry_url"),
        pick(endpoint, "string", "s.json_endpoint").alias("json_endpoint"),
        pick(today, "date", "s.verified_at").alias("verified_at"),
        pick(F.coalesce("o.jobs", F.lit(0)), "long", "s.jobs_last_seen").alias("jobs_last_seen"),
        F.when(won, 0).when(mark, none("int")).when(counted, failures).otherwise(F.col("s.consecutive_failures")).alias("consecutive_failures"),
        pick(F.coalesce("o.from_hint", F.lit(False)) | proven, "boolean", "s.proven").alias("proven"),
        F.when(won, False).when(mark, True).otherwise(F.col("s.unsupported")).alias("unsupported"),
        F.when(won, none("date")).when(mark, today).otherwise(F.col("s.checked_at")).alias("checked_at"),
    )


def may_send(new: Column, changed: Column, complete: Column, reasons: Column, unknown_companies: Column) -> Column:
    """Whether a digest goes out: something to say, and either a complete run, or one cut only where
    the gap can be described, or one where few companies were cut otherwise."""
    unknown = F.array_except(F.coalesce(reasons, F.array().cast("array<string>")), F.array(*[F.lit(r) for r in DESCRIBABLE]))
    some = F.size(F.coalesce(reasons, F.array().cast("array<string>"))) > 0
    affected = F.coalesce(unknown_companies, F.when(F.size(unknown) > 0, UNKNOWN_LIMIT + 1).otherwise(0))
    told = (some & (F.size(unknown) == 0)) | ((F.size(unknown) > 0) & (affected <= UNKNOWN_LIMIT))
    return ((new > 0) | (changed > 0)) & (complete | told)
