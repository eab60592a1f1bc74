"""One full run over harvested records: filter, score, deduplicate, update the store, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import dates, identity, matching, text, urls
from ..operators import dedup, lifecycle
from ..operators.buckets import BucketStore
from ..operators.store import Store
from ..sinks import places


@dataclass(frozen=True)
class Settings:
    hours: int = dates.HOURS
    include: tuple = matching.INCLUDE
    exclude: tuple = matching.EXCLUDE


def build(raw: DataFrame) -> DataFrame:
    """Cleaned records with ids; rows without title or URL are dropped, remote is inferred only if absent."""
    out = raw.withColumns({c: text.clean(F.col(c)) for c in ("company", "title", "location", "employment_type")})
    out = out.withColumns({"description": text.strip_html(F.col("description")), "job_url": F.nullif(F.trim("job_url"), F.lit("")), "remote": F.coalesce("remote", text.infer_remote(F.col("location"), F.col("title")))})
    out = out.where("title is not null and job_url is not null")
    return out.withColumn("job_id", identity.job_id(F.col("job_url"), F.col("ats_provider"), F.col("company")))


class Stages:
    """How many rows each stage of select() lets through, counted as they pass: the pass that writes its result
    counts them, none is made for the counts. They are there once that pass is over."""

    def __init__(self):
        self.seen = [Observation() for _ in range(3)]

    def through(self, df: DataFrame, stage: int, *counts: Column) -> DataFrame:
        return df.observe(self.seen[stage], *counts)

    def counts(self) -> dict[str, int]:
        """collected, target_role, location_match, within_window, date_unavailable, older."""
        return {k: n for o in self.seen for k, n in o.get.items()}


def select(records: DataFrame, first_seen: DataFrame, now: Column, settings: Settings = Settings(), stages: Stages | None = None) -> DataFrame:
    """Records that pass role, place and window, with what decided; undated ones stay and say so."""
    if stages:
        records = stages.through(records, 0, F.count(F.lit(1)).alias("collected"))
    hit = records.where(matching.role(F.col("title"), settings.include, settings.exclude))
    if stages:
        hit = stages.through(hit, 1, F.count(F.lit(1)).alias("target_role"))
    hit = hit.withColumn("location_match_type", matching.location_match(F.col("location"), F.col("title"), F.col("remote"))).where("location_match_type is not null")
    hit = hit.join(first_seen.select("job_id", F.col("first_seen").alias("_seen")), "job_id", "left")
    status, source = dates.freshness(F.col("date_posted"), F.col("_seen"), now, settings.hours)
    hit = hit.withColumns({"date_filter_status": status, "date_source": source, "remote_scope": matching.remote_scope(F.col("location"), F.col("title"), F.col("remote"))})
    if stages:
        at = lambda x: F.count_if(F.col("date_filter_status") == x)
        hit = stages.through(hit, 2, F.count(F.lit(1)).alias("location_match"), at(S.WITHIN).alias("within_window"), at(S.UNDATED).alias("date_unavailable"), at(S.OLDER).alias("older"))
    return hit.where(F.col("date_filter_status") != S.OLDER).drop("_seen")


def best(records: DataFrame) -> DataFrame:
    """One copy of each posting: by canonical URL, then by id or composite key; dated copies
    first, then described ones, then direct ones, then the earliest."""
    direct = (F.col("scraping_method") == "direct_api").cast("int")
    described = F.coalesce(F.col("description"), F.lit("")) != ""
    quality = [F.col("date_posted").isNotNull().cast("int"), described.cast("int"), F.coalesce(direct, F.lit(0))]
    composite = identity.duplicate_key(F.col("company"), F.col("title"), F.col("location"), F.col("job_url"))
    return dedup.two_passes(records, F.coalesce(urls.normalize(F.col("job_url")), F.lit("")), F.col("job_id"), composite, quality)


def _written(df: DataFrame, what: str) -> DataFrame:
    """df from files below the shared folder, so that what reads it twice does the work once."""
    at = places.scratch(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def run(raw: DataFrame, results: DataFrame, store: Store, now: Column, settings: Settings = Settings(), stages: Stages | None = None) -> DataFrame:
    """raw: harvested rows with `seq`; results: company, success, complete, jobs, previous. Commits the
    store's next version and returns the export: selected postings with score and change status. Records
    and the updated rows are written once and read from there; of a store in buckets only those of the
    companies in raw and results are read and written. `stages` has the stages' counts afterwards."""
    records = _written(build(raw), "records")
    own = None
    if isinstance(store, BucketStore):
        own = store.touched(records.select(store.key).unionByName(results.select(store.key)))
    state = store.read() if own is None else store.read(own)
    known = state.select("job_id", "first_seen")
    chosen = best(select(records, known, now, settings, stages))
    scored = chosen.withColumn("fit", matching.fit(F.col("title"), F.col("description"))).select("*", F.col("fit.score").alias("fit_score"), F.array_join("fit.matched", ", ").alias("fit_matched"), F.col("fit.explanation").alias("fit_explanation")).drop("fit")
    scored = _written(scored, "scored")
    updated = lifecycle.upsert(state, records.select("job_id", "job_url", "company", "title", "location", "date_posted", "seq"), now)
    updated = _written(updated, "updated")
    told = lifecycle.removal_allowed(F.col("success"), F.col("jobs"), F.col("complete"), F.col("previous"))
    synced = lifecycle.sync(updated.drop("change"), records.select("company", "job_id").distinct(), results.where(told))
    store.commit(synced) if own is None else store.commit(synced, buckets=own)
    return scored.join(updated.select("job_id", F.col("change").alias("change_status"), "first_seen"), "job_id", "left")
