import random

import pytest
from pyspark.sql import functions as F

from harrow.operators import lifecycle
from harrow.streaming import postings

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def log_of(rng, companies, runs):
    """Sightings of each run, then its row; runs of several companies one after another."""
    out = []
    for r in range(1, runs + 1):
        for c in range(companies):
            pool = [f"{c}-{i}" for i in range(40 if c == 0 else 8)]
            here = [j for j in pool if rng.random() < rng.choice([0.2, 0.7, 0.9])]
            success, complete = rng.random() < 0.9, rng.random() < 0.85
            out += [(f"c{c}", j, r, None, None, None) for j in here + here[:2]]
            out.append((f"c{c}", None, r, success, complete, len(here)))
    return out


def rows(df):
    return sorted(map(tuple, df.select("company", "job_id", "first_seen", "last_seen", "misses").collect()))


def test_equals_the_history_for_any_split_and_restart(rocks, tmp_path):
    spark, rng = rocks, random.Random(4)
    log = log_of(rng, 3, 9)
    cuts = sorted(rng.sample(range(1, len(log)), 4))
    parts = [log[a:b] for a, b in zip([0, *cuts], [*cuts, len(log)], strict=True)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, postings.LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (1, 2, 4):  # the query stops in between and goes on from its checkpoint
            stream = spark.readStream.schema(postings.LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            out = postings.changes(stream, shards=2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            out.awaitTermination()
            told = spark.createDataFrame([x for p in parts[: k + 1] for x in p], postings.LOG)
            runs = told.where("job_id is null").drop("job_id")
            seen = told.where("job_id is not null").select("company", "job_id", "run").join(runs.select("company", "run"), ["company", "run"], "left_semi")
            want = lifecycle.history(runs, seen)
            assert rows(postings.current(spark.read.schema(postings.CHANGES).parquet(f"{tmp_path}/out"))) == rows(want)
    changed = spark.read.parquet(f"{tmp_path}/out")
    assert changed.where("event = 'removed'").count() > 0
    still = postings.current(changed).select("company", "job_id")
    last = changed.where("job_id is not null").groupBy("company", "job_id").agg(F.max_by("event", F.struct("run", F.col("event") == "removed")).alias("event"))
    assert last.where("event = 'removed'").join(still, ["company", "job_id"]).count() == 0
