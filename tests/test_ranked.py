from pyspark.sql import functions as F

from harrow.operators import report


def test_places_hold_when_partitions_are_joined_as_they_come(spark):
    """Spark joins small partitions of a shuffle by their bytes: what reads fewer columns has fewer of them."""
    told = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200000", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "40"}
    held = {k: spark.conf.get(k) for k in told}
    try:
        for k, v in told.items():
            spark.conf.set(k, v)
        k = F.col("id")
        df = spark.range(0, 40000, 1, 7).select((k * 7919 % 40000).alias("seq"), F.sha2(k.cast("string"), 512).alias("wide"))
        got = report.ranked(df, [F.desc(F.col("seq") % 3)], "seq").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = {s: i for i, s in enumerate(sorted(range(40000), key=lambda s: (-(s % 3), s)), 1)}
    assert len(got) == 40000 and all(want[r.seq] == r.rank for r in got)
