"""Postings over runs: new, changed, missing, removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import identity

#: Misses after which a posting is gone; least previous count and share for a collapse.
MISSES, COLLAPSE_FROM, COLLAPSE_SHARE = 2, 20, 0.5
TRACKED = ("title", "location", "job_url")


def collapsed(previous: Column, now: Column) -> Column:
    """Far fewer postings than the run before had: the run is not believed."""
    return F.coalesce((previous >= COLLAPSE_FROM) & (now < previous * COLLAPSE_SHARE), F.lit(False))


def removal_allowed(success: Column, jobs: Column, complete: Column, previous: Column) -> Column:
    return F.coalesce(success & (jobs > 0) & complete, F.lit(False)) & ~collapsed(previous, jobs)


def history(runs: DataFrame, sightings: DataFrame, company: str = "company", job: str = "job_id", run: str = "run") -> DataFrame:
    """What a store would hold after all runs, without replaying them.

    runs: company, run, success, complete, n (postings found); sightings: company, job, run. A run
    that may remove advances its company's clock; a posting whose clock lags two behind was deleted,
    and comes back as new. Gives company, job, first_seen, last_seen, misses of those still there."""
    by = W.partitionBy(company).orderBy(run)
    previous = F.lag(F.when(F.col("success"), F.col("n")).otherwise(0)).over(by)
    told = runs.withColumn("ql", removal_allowed(F.col("success"), F.col("n"), F.col("complete"), previous).cast("int"))
    told = told.withColumn("q", F.sum("ql").over(by))
    last = told.groupBy(company).agg(F.max("q").alias("max_q"))
    seen = sightings.join(told.where("success and n > 0").select(company, run, "q", "ql"), [company, run])
    per = W.partitionBy(company, job).orderBy(run)
    gap = F.col("q") - F.col("ql") - F.lag("q").over(per) >= MISSES
    islands = seen.withColumn("island", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(per))
    spans = islands.groupBy(company, job, "island").agg(F.min(run).alias("first_seen"), F.max(run).alias("last_seen"), F.max("q").alias("lq"))
    latest = spans.groupBy(company, job).agg(F.max_by(F.struct("first_seen", "last_seen", "lq"), "island").alias("s")).select(company, job, "s.*")
    misses = F.col("max_q") - F.col("lq")
    return latest.join(last, company).where(misses < MISSES).select(company, job, "first_seen", "last_seen", misses.cast("int").alias("misses"))


def changed_fields(new: str, old: str, fields=TRACKED) -> Column:
    differ = lambda f: ~F.coalesce(F.col(f"{new}.{f}"), F.lit("")).eqNullSafe(F.coalesce(F.col(f"{old}.{f}"), F.lit("")))
    return F.array_compact(F.array(*[F.when(differ(f), F.lit(f)) for f in fields]))


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("record_hash", identity.record_hash(F.col("title"), F.col("location"), F.col("job_url")))


def one_a_key(batch: DataFrame) -> DataFrame:
    """Repeated ids of a batch are one row: later values win unless they are null."""
    value = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return batch.groupBy("job_id").agg(*[value(c) for c in batch.columns if c not in ("job_id", "seq")], F.max("seq").alias("seq"))


def upsert(state: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """The store after a batch: state and batch joined once on job_id.

    New ids enter with first_seen; known ones get the new URL, hash and last_seen, keep what the
    batch leaves null, and are marked when a tracked field differs. Rows of the batch without id or
    URL are left out. `change` says new, changed or unchanged, null for rows the batch did not have."""
    rows = with_hash(one_a_key(batch.where("job_id != '' and job_url != ''")))
    n, o = rows.select(F.col("job_id").alias("nid"), F.struct(*[c for c in rows.columns if c != "seq"]).alias("n")), state.select(F.col("job_id").alias("oid"), F.struct(*state.columns).alias("o"))
    both = n.join(o, F.col("nid") == F.col("oid"), "full")
    fields = F.when((F.col("n.record_hash") != F.col("o.record_hash")), changed_fields("n", "o"))
    both = both.withColumn("fields", fields).withColumn("change", F.when(F.col("nid").isNull(), None).when(F.col("oid").isNull(), S.NEW).when(F.size("fields") > 0, S.CHANGED).otherwise(S.UNCHANGED))
    hit = F.col("nid").isNotNull()
    newer = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    changed = F.col("change") == S.CHANGED
    return both.select(
        F.coalesce("nid", "oid").alias("job_id"),
        newer("job_url"),
        F.coalesce("o.company", "n.company").alias("company"),
        newer("title"),
        newer("location"),
        F.coalesce("o.first_seen", now).alias("first_seen"),
        F.when(hit, now).otherwise(F.col("o.last_seen")).alias("last_seen"),
        newer("date_posted"),
        F.when(hit, 0).otherwise(F.col("o.misses")).alias("misses"),
        newer("record_hash"),
        F.when(changed, now).otherwise(F.col("o.changed_at")).alias("changed_at"),
        F.when(changed, F.col("fields")).otherwise(F.col("o.changed_fields")).alias("changed_fields"),
        "change",
    )


def sync(state: DataFrame, current: DataFrame, allowed: DataFrame) -> DataFrame:
    """Count a miss for what an allowed company no longer lists, and drop rows at MISSES.

    current: company, job_id; allowed: company (those whose run may remove)."""
    kept = state.join(allowed.select("company", F.lit(True).alias("_ok")).distinct(), "company", "left").join(current.select("company", "job_id", F.lit(True).alias("_here")).distinct(), ["company", "job_id"], "left")
    missed = F.col("_ok").isNotNull() & F.col("_here").isNull()
    kept = kept.withColumn("misses", F.when(missed, F.col("misses") + 1).when(F.col("_here").isNotNull(), 0).otherwise(F.col("misses")))
    return kept.where(~missed | (F.col("misses") < MISSES)).select(*state.columns)


def unannounced(rows: DataFrame, sent: DataFrame) -> DataFrame:
    """Rows whose (job_id, kind) was not sent yet."""
    return rows.join(sent.select("job_id", "kind").distinct(), ["job_id", "kind"], "left_anti")


def with_history(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """jobs with first_seen of the store and is_new (the store did not know the id)."""
    known = state.select("job_id", F.col("first_seen").alias("_seen"), F.lit(True).alias("_known"))
    out = jobs.drop("first_seen", "is_new").join(known, "job_id", "left")
    return out.withColumns({"first_seen": F.col("_seen"), "is_new": F.col("_known").isNull()}).drop("_seen", "_known")


def stats(state: DataFrame) -> DataFrame:
    """company, jobs of the store."""
    return state.groupBy("company").agg(F.count("*").alias("jobs"))


def company_ids(state: DataFrame, companies: DataFrame) -> DataFrame:
    """company, job_id that the store holds of these companies."""
    return state.join(companies.select("company").distinct(), "company", "left_semi").select("company", "job_id")


def upsert_counts(batch: DataFrame, state: DataFrame) -> DataFrame:
    """added, changed, unchanged of a batch's rows before it is upserted: repeated ids count each."""
    rows = with_hash(batch.where("job_id != '' and job_url != ''"))
    o = state.select("job_id", F.struct(*[c for c in state.columns if c != "job_id"]).alias("o"))
    both = rows.select("job_id", F.struct(*rows.columns).alias("n")).join(o, "job_id", "left")
    known = F.col("o").isNotNull()
    moved = known & ~F.col("n.record_hash").eqNullSafe(F.col("o.record_hash")) & (F.size(changed_fields("n", "o")) > 0)
    return both.agg(F.count_if(~known).alias("added"), F.count_if(moved).alias("changed"), F.count_if(known & ~moved).alias("unchanged"))


def removed_counts(state: DataFrame, current: DataFrame, allowed: DataFrame) -> DataFrame:
    """company, removed, missing of what sync() does: missing rows hold those that it removes."""
    listed = state.join(allowed.select("company").distinct(), "company", "left_semi")
    missing = listed.join(current.select("company", "job_id").distinct(), ["company", "job_id"], "left_anti")
    return missing.groupBy("company").agg(F.count_if(F.col("misses") + 1 >= MISSES).alias("removed"), F.count("*").alias("missing"))


def changed_since(state: DataFrame) -> DataFrame:
    """Postings that carry a change mark."""
    return state.where("changed_fields is not null").select("job_id", "company", "title", "location", "job_url", "changed_fields")


def clear_marks(state: DataFrame) -> DataFrame:
    """The store once its changes are reported; when they happened stays."""
    return state.withColumn("changed_fields", F.lit(None).cast("array<string>"))


def record_notified(sent: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """sent (job_id, kind, sent_at) after a digest went out: pairs known already keep their time, rows
    without an id are left out, and a pair that comes twice counts once."""
    new = rows.where("job_id != ''").select("job_id", "kind").distinct()
    return sent.unionByName(unannounced(new, sent).select("job_id", "kind", now.alias("sent_at")))


def changed_matching(changed: DataFrame, exported: DataFrame) -> DataFrame:
    """Changed postings that the export holds."""
    return changed.join(exported.select("job_id").distinct(), "job_id", "left_semi")
