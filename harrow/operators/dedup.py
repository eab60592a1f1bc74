"""Keep the best copy of each posting. Columns `seq` give the arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_best(df: DataFrame, key: Column, quality: list[Column], seq: str = "seq") -> DataFrame:
    """One row a key: the best by the quality columns (larger is better), the earliest on a tie. It
    takes the place (`seq`) of its key's first row. One aggregation with partial sums: a key with
    very many rows sends one row a task."""
    best = F.struct(*[q.alias(f"q{i}") for i, q in enumerate(quality)], (-F.col(seq)).alias("early"))
    grouped = df.withColumn("_k", key).groupBy("_k").agg(F.max_by(F.struct(*df.columns), best).alias("_row"), F.min(seq).alias("_place"))
    return grouped.select(*[F.col("_place").alias(c) if c == seq else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def two_passes(df: DataFrame, url_key: Column, job_id: Column, composite: Column, quality: list[Column], seq: str = "seq") -> DataFrame:
    """First by canonical URL, then by posting id where there is one, else by the composite key."""
    first = keep_best(df, url_key, quality, seq)
    named = job_id.isNotNull() & (job_id != "")
    return keep_best(first, F.when(named, F.concat(F.lit("id"), job_id)).otherwise(F.concat(F.lit("u"), composite)), quality, seq)


def first_of_each(df: DataFrame, by: list[str], url: str, seq: str = "seq") -> DataFrame:
    """The first row of each group and URL; rows without a URL are all kept. One aggregation with partial
    sums, as keep_best()."""
    some = F.coalesce(F.trim(url), F.lit("")) != ""
    best = df.where(some).groupBy(*by, url).agg(F.min_by(F.struct(*df.columns), seq).alias("_row"))
    return best.select(*[F.col(f"_row.`{c}`").alias(c) for c in df.columns]).unionByName(df.where(~some))
