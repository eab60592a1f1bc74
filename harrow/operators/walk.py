"""Where a walk over result pages ends, and what it collected, from a log of the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_PAGES = 500
SHORTFALL_SHARE = 0.02
#: Narrow rows that one task sorts or groups at once.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as `rows` rows ask for. Left to itself, Spark joins shuffled partitions
    by their compressed bytes, and narrow rows take fifty times theirs in memory."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def walk(pages: DataFrame, source: str = "source", most: int = 8000, rows: int | None = None) -> DataFrame:
    """pages: source, page_no, rows array<key>, total (reported, nullable), failed; and, if there, stale:
    all dated rows of the page are older than wanted (false when none is dated).

    Per page, checked in this order: failure, empty, repeated page, nothing new, a second stale page in
    a row (only where the total is beyond the budget), total reached, a
    page shorter than the first (only without a total), row budget, page ceiling. The first page on
    which one holds ends the walk; that page still counts unless it failed, was empty or repeated.
    Gives per source: pages, offset (rows received), collected (distinct keys), total, stop_reason,
    complete, shortfall.

    rows: about how many keys all pages hold (none: they are counted first). Pages go once to their source's
    task, and no further shuffle follows; pages after the ceiling, which no walk reaches, end there."""
    if rows is None:
        rows = pages.agg(F.sum(F.greatest(F.lit(1), F.size("rows")))).first()[0] or 0
    by = W.partitionBy(source).orderBy("page_no")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    p = dealt(pages, rows, source).where(F.col(source).isNotNull())
    p = p.withColumn("_rank", F.rank().over(by)).where(F.col("_rank") <= MAX_PAGES)
    p = p.withColumns({"size": F.coalesce(F.size("rows"), F.lit(0)), "print": F.sha1(F.to_json("rows"))})
    told = [c for c in ("size", "print", "total", "failed", "stale") if c in p.columns]
    flat = p.withColumn("page", F.struct(*told)).select(source, "page_no", "page", F.posexplode_outer("rows").alias("pos", "key"))
    first = F.row_number().over(W.partitionBy(source, "key").orderBy("page_no")) == 1
    flat = flat.select(source, "page_no", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("page")).alias("page"), (first & F.col("key").isNotNull()).alias("new"))
    p = flat.groupBy(source, "page_no").agg(F.max("page").alias("page"), F.count_if("new").alias("fresh")).select(source, "page_no", "page.*", "fresh")
    again = W.partitionBy(source, "print").orderBy("page_no")
    p = p.withColumns(
        {
            "known": F.first("total", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)),
            "offset": F.coalesce(F.sum("size").over(before), F.lit(0)),
            "got": F.sum("fresh").over(by.rowsBetween(W.unboundedPreceding, 0)),
            "first_size": F.first("size").over(by),
            "copy": F.row_number().over(again),
            "nth": F.row_number().over(by),
        }
    )
    stale = F.lit(False)
    if "stale" in pages.columns:
        stale = F.col("stale") & F.lag("stale").over(by) & (F.col("known") > most)
    reason = (
        F.when(F.col("failed"), "page_failed")
        .when(F.col("size") == 0, "exhausted")
        .when(F.col("copy") > 1, "repeated_page")
        .when(F.col("fresh") == 0, "no_new_rows")
        .when(F.coalesce(stale, F.lit(False)), "freshness_reached")
        .when(F.col("got") >= F.col("known"), "reported_total_reached")
        .when(F.col("known").isNull() & (F.col("size") < F.greatest(F.lit(1), F.col("first_size"))), "exhausted")
        .when(F.col("got") >= most, "budget_exhausted")
        .when(F.col("nth") >= MAX_PAGES, "page_ceiling")
    )
    p = p.withColumn("reason", reason)
    stop = F.min(F.when(F.col("reason").isNotNull(), F.col("page_no"))).over(W.partitionBy(source))
    seen = p.withColumn("stop_page", stop).where("stop_page is null or page_no <= stop_page")
    counts = ~F.coalesce(F.col("reason").isin("page_failed", "repeated_page", "no_new_rows") | (F.col("size") == 0), F.lit(False))
    out = seen.groupBy(source).agg(
        F.count_if(~F.coalesce(F.col("failed"), F.lit(False))).alias("pages"),
        F.sum(F.when(counts, F.col("size")).otherwise(0)).alias("offset"),
        F.sum(F.when(counts, F.col("fresh")).otherwise(0)).alias("collected"),
        F.max_by("known", "page_no").alias("total"),
        F.coalesce(F.max_by("reason", "page_no"), F.lit("exhausted")).alias("reason"),
    )
    short = F.greatest(F.lit(0), F.coalesce("total", F.lit(0)) - F.col("collected"))
    lacking = short > F.greatest(F.lit(1), F.floor(F.coalesce("total", F.lit(0)) * SHORTFALL_SHARE))
    ended = F.col("reason").isin("exhausted", "reported_total_reached")
    stop_reason = F.when((F.col("reason") == "exhausted") & lacking, "total_shortfall").otherwise(F.col("reason"))
    return out.select(source, "pages", "offset", "collected", "total", stop_reason.alias("stop_reason"), (ended & ~lacking).alias("complete"), short.alias("shortfall"))


#: Steps in a row that add nothing and so end a click log.
BARREN = 2


def clicks(log: DataFrame, source: str = "source", most: int = 1 << 30, budget: float | None = None) -> DataFrame:
    """Walks by a browser that clicks for more. log: source, step (0: before the first click), rows
    array<key>, seconds since the start. A walk ends with the second step in a row that adds no key
    (exhausted), or at `most` clicks or `budget` seconds (not exhausted), or with its log (exhausted)."""
    by = W.partitionBy(source).orderBy("step")
    over = F.col("step") > most
    if budget is not None:
        over = over | (F.lag("seconds").over(by) >= budget)
    flat = log.select(source, "step", F.explode("rows").alias("key")).where("key is not null and key != ''")
    new = flat.groupBy(source, "key").agg(F.min("step").alias("step")).groupBy(source, "step").agg(F.count("*").alias("added"))
    s = log.join(new, [source, "step"], "left").withColumn("added", F.coalesce("added", F.lit(0)))
    bare = (F.col("added") == 0) & (F.col("step") > 0)
    s = s.withColumns({"over": (F.col("step") > 0) & over, "bare": bare}).withColumn("ends", F.col("bare") & F.coalesce(F.lag("bare").over(by), F.lit(False)))
    end = s.groupBy(source).agg(F.min(F.when(F.col("over"), F.col("step"))).alias("_cut"), F.min(F.when(F.col("ends"), F.col("step"))).alias("_end"))
    cut = F.col("_cut").isNotNull() & (F.col("_end").isNull() | (F.col("_cut") <= F.col("_end")))
    kept = s.join(end, source).where(~F.coalesce(cut & (F.col("step") >= F.col("_cut")), F.lit(False)) & ~F.coalesce(F.col("step") > F.col("_end"), F.lit(False)))
    return kept.groupBy(source).agg(F.sum("added").alias("collected"), F.max("step").alias("clicks"), (~F.max(F.coalesce(cut, F.lit(False)))).alias("exhausted"))
