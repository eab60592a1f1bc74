"""A partial run merged into the last full one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_rows(previous: DataFrame, fresh: DataFrame, companies: DataFrame, key: str = "job_id") -> DataFrame:
    """companies: company, success, authoritative. An authoritative company's rows are replaced; a
    successful one's fresh rows are joined by id; others stay. An id comes out of the fresh rows once: the
    last of them (by seq) takes the place of the last previous row with that id, or else the place of the
    first of them. Rows whose id is null or empty are all kept. `seq` orders the result: previous places
    first, then the fresh rows."""
    told = companies.select("company", (F.col("success") & F.col("authoritative")).alias("_replace"), F.col("success").alias("_merge"))
    cols = previous.columns
    named = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    p = previous.join(told, "company", "left").where("not coalesce(_replace, false)").select(F.struct(*cols).alias("p"), F.when(named, F.col(key)).alias("pi"), F.col("seq").alias("ps"))
    f = fresh.join(told.where("_merge"), "company").select(F.struct(*cols).alias("f"), F.when(named, F.col(key)).alias("fi"), F.col("seq").alias("fs"))
    one = f.where("fi is not null").groupBy("fi").agg(F.max_by("f", "fs").alias("f"), F.min("fs").alias("first"))
    last = p.where("pi is not null").groupBy(F.col("pi").alias("fi")).agg(F.max("ps").alias("last"))
    one = one.join(last, "fi", "left").unionByName(f.where("fi is null").select("fi", "f", F.col("fs").alias("first"), F.lit(None).cast(p.schema["ps"].dataType).alias("last")))
    both = p.join(one, (F.col("pi") == F.col("fi")) & (F.col("ps") == F.col("last")), "full")
    value = lambda c: F.when(F.col("f").isNotNull(), F.col(f"f.{c}")).otherwise(F.col(f"p.{c}"))
    order = F.when(F.col("p").isNotNull(), F.struct(F.lit(0).alias("t"), F.col("ps").alias("s"))).otherwise(F.struct(F.lit(1).alias("t"), F.col("first").alias("s")))
    return both.select(*[value(c).alias(c) for c in cols], order.alias("place"))


def merge_report(previous: DataFrame, current: DataFrame, key: str = "company") -> DataFrame:
    """Rows of current replace those of previous by key; new ones are added."""
    return previous.join(current.select(key).distinct(), key, "left_anti").unionByName(current)


def fill_blank(table: DataFrame, found: DataFrame, key: str, column: str, blank: Column) -> DataFrame:
    """A discovered value goes only where the cell says nothing."""
    f = found.select(key, F.col(column).alias("_found")).dropDuplicates([key])
    return table.join(f, key, "left").withColumn(column, F.when(blank & F.col("_found").isNotNull(), F.col("_found")).otherwise(F.col(column))).drop("_found")


def replace_exact(table: DataFrame, repairs: DataFrame, key: str, column: str) -> DataFrame:
    """repairs: key, dead, repaired. A cell is overwritten only while it still holds the dead value."""
    r = repairs.select(key, "dead", "repaired").dropDuplicates([key, "dead"])
    joined = table.join(r, (table[key] == r[key]) & (table[column] == r["dead"]), "left").drop(r[key])
    return joined.withColumn(column, F.coalesce("repaired", column)).drop("dead", "repaired")


def union_results(*harvests: DataFrame) -> DataFrame:
    """All companies' postings as one table; columns that one harvest lacks are null."""
    out = harvests[0]
    for h in harvests[1:]:
        out = out.unionByName(h, allowMissingColumns=True)
    return out


def carried(failures: DataFrame, attempted: DataFrame) -> DataFrame:
    """Failures of an earlier run whose companies this run did not visit."""
    return failures.join(attempted.select("company").distinct(), "company", "left_anti").select(*failures.columns)


def enrich(rows: DataFrame, details: DataFrame, wanted: Column, columns: tuple[str, ...] = ("location", "description", "date_posted"), key: str = "job_url") -> DataFrame:
    """Details laid back onto the rows that wanted them: what the detail says wins, what it leaves null stays."""
    d = details.groupBy(key).agg(*[F.max(c).alias(f"_{c}") for c in columns])
    out = rows.join(d, key, "left")
    return out.withColumns({c: F.when(wanted, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in columns}).select(*rows.columns)


def verified_repair(results: DataFrame) -> DataFrame:
    """source, raw_url, url of repaired addresses that served postings, and so may replace the dead ones.
    One that a page led further away from is only taken where the dead one stood among the ATS addresses."""
    there = F.coalesce(F.col("raw_url"), F.lit("")) != ""
    ok = F.col("success") & F.col("was_repaired") & there & (F.coalesce(F.col("url"), F.lit("")) != "") & (F.col("url") != F.col("raw_url"))
    superseded = F.coalesce(F.col("resolved_via_page"), F.lit(False)) & (F.col("source") == "live_jobs_url")
    return results.where(F.coalesce(ok & ~superseded, F.lit(False)))
