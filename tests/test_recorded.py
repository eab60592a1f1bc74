import random

import pytest
from pyspark.sql import functions as F

from harrow.operators import walk
from harrow.sources import recorded

COLUMNS = ["source", "pages", "offset", "collected", "total", "stop_reason", "complete", "shortfall"]


def exchanges(rng, n):
    """Logs of walks that end in every way."""
    out = []
    for s in range(n):
        size, pages = rng.choice([1, 5, 10]), rng.randint(1, 9)
        total = rng.choice([None, size * pages, size * pages + rng.randint(0, 30), 3])
        keys = [f"k{i}" for i in range(size * pages)]
        for p in range(pages):
            rows = keys[p * size : (p + 1) * size]
            roll = rng.random()
            rows = [] if roll < 0.06 else keys[:size] if roll < 0.12 else rows[: max(1, size - 2)] if roll < 0.2 else [rows[0], None, *rows] if roll < 0.25 else rows
            failed = rng.random() < 0.06
            tries = rng.randint(0, 1) if not failed else 2
            stale = rng.random() < 0.4
            told = total if rng.random() < 0.8 else None
            for a in range(tries):
                out.append((f"s/{s} é", p, a, rng.choice([429, 500, 503]), rng.choice([None, 2.0, 500.0]), None, told if not p else None, stale))
            if not failed:
                out.append((f"s/{s} é", p, tries, 200, None, rows, told, stale))
    return out


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


def test_equals_the_walk_over_the_log(spark, tmp_path):
    log = spark.createDataFrame(exchanges(random.Random(1), 80), recorded.EXCHANGE)
    recorded.register(spark)
    recorded.write(log, f"{tmp_path}/x")
    good = F.col("status") == 200
    pages = log.groupBy("source", "page_no").agg(F.max_by("rows", F.when(good, F.col("attempt"))).alias("rows"), F.min_by("total", F.when(F.col("total").isNotNull(), F.col("attempt"))).alias("total"), F.max("stale").alias("stale"), (~F.max(good)).alias("failed"))
    seen = set()
    for most in (8000, 12):
        want = rows(walk.walk(pages, most=most))
        for each in (1, 7):
            for path in (f"{tmp_path}/x", f"file://{tmp_path}/x"):
                got = spark.read.format("recorded").option("path", path).option("most", most).option("perPartition", each).load()
                assert got.rdd.getNumPartitions() == -(-80 // each)
                assert rows(got) == want
        seen |= {r[5] for r in want}
        items = spark.read.format("recorded").option("path", f"{tmp_path}/x").option("most", most).option("emit", "items").load()
        counts = {r[0]: r[1] for r in items.groupBy("source").agg(F.count("*")).collect()}
        assert counts == {r[0]: r[3] for r in want if r[3]}
    assert seen >= {"page_failed", "exhausted", "repeated_page", "reported_total_reached", "budget_exhausted", "total_shortfall", "freshness_reached"}


def test_attempts_and_waits(spark, tmp_path):
    log = [("a", 0, 0, 429, 7.0, None, None, False), ("a", 0, 1, 200, None, ["x", "y"], 9, False), ("a", 1, 0, 503, None, None, None, False), ("a", 1, 1, 429, 900.0, None, None, False), ("a", 1, 2, 200, None, ["z"], None, False), ("b", 0, 0, 404, None, None, None, False)]
    recorded.register(spark)
    recorded.write(spark.createDataFrame(log, recorded.EXCHANGE), f"{tmp_path}/x")
    read = lambda n: {r.source: r for r in spark.read.format("recorded").options(path=f"{tmp_path}/x", attempts=n, backoff=0.5).load().collect()}
    two, three = read(2), read(3)
    assert (two["a"].stop_reason, two["a"].collected, two["a"].requests, two["a"].waited) == ("page_failed", 2, 4, 7.5)
    assert (three["a"].stop_reason, three["a"].collected, three["a"].requests, three["a"].waited) == ("total_shortfall", 3, 5, 127.5)
    assert two["b"].stop_reason == "page_failed" and two["b"].pages == 0 and not two["b"].complete


def test_no_exchanges(spark, tmp_path):
    recorded.register(spark)
    (tmp_path / "x").mkdir()
    assert spark.read.format("recorded").option("path", f"{tmp_path}/x").load().count() == 0


def test_files_follow_the_rows_not_the_sources(spark, tmp_path):
    """Few files for many sources, names that look like the next field, a missing name, sources longer than a block."""
    names = [None, "", 'a","page_no":1', "a\nb", "é\\", *(f"s{i}" for i in range(300))]
    log = [(s, p, 0, 200, None, [f"{p}-{i}" for i in range(1 + k % 3)], None, False) for k, s in enumerate(names) for p in range(2)]
    log += [("long", p, 0, 200, None, [f"{p}-{i}-{'x' * 300}" for i in range(1000)], None, False) for p in range(6)]
    recorded.register(spark)
    for rows in (None, 2 * 10**6):
        at = f"{tmp_path}/{rows}"
        recorded.write(spark.createDataFrame(log, recorded.EXCHANGE), at, rows)
        files = [f for f in (tmp_path / str(rows)).rglob("*.json")]
        assert len(files) <= 8 and not list((tmp_path / str(rows)).rglob("*.tmp*"))
        for each in (1, 16, 1000):
            out = spark.read.format("recorded").options(path=at, perPartition=each).load()
            assert out.rdd.getNumPartitions() == -(-(len(names) + 1) // each)
            got = {r.source: (r.pages, r.collected, r.stop_reason) for r in out.collect()}
            assert got == {s: (2, 2 * (1 + k % 3), "exhausted") for k, s in enumerate(names)} | {"long": (6, 6000, "exhausted")}


def test_files_without_starts(spark, tmp_path):
    recorded.register(spark)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part-0.json").write_text("{}\n")
    with pytest.raises(Exception, match="write the exchanges again"):
        spark.read.format("recorded").option("path", f"{tmp_path}/x").load().count()
