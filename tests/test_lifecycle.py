import random
from pyspark.sql import functions as F

from harrow.operators import dedup, lifecycle, merge, walk

DAY = lambda n: F.lit(f"2024-01-{n:02d}").cast("timestamp")
ROW = "job_id string, job_url string, company string, title string, location string, date_posted timestamp, seq long"


def batch(spark, *jobs):
    return spark.createDataFrame([(j, f"http://x/{j}", "c", t, "Dallas, TX", None, i) for i, (j, t) in enumerate(jobs)], ROW)


def test_five_runs(spark):
    empty = spark.createDataFrame([], "job_id string, job_url string, company string, title string, location string, first_seen timestamp, last_seen timestamp, date_posted timestamp, misses int, record_hash string, changed_at timestamp, changed_fields array<string>")
    runs = [(["1", "2", "3"], True), (["1", "2", "3"], True), (["1", "2*", "4"], True), (["1"], False), (["1", "2*", "4"], True)]
    want = [{"new": 3}, {"unchanged": 3}, {"new": 1, "changed": 1, "unchanged": 1}, {"unchanged": 1}, {"unchanged": 3}]
    state = empty
    for day, ((ids, complete), counts) in enumerate(zip(runs, want, strict=True), 1):
        b = batch(spark, *[(i.strip("*"), "new title" if "*" in i else "title") for i in ids])
        out = lifecycle.upsert(state, b, DAY(day)).cache()
        assert {r.change: r["count"] for r in out.where("change is not null").groupBy("change").count().collect()} == counts
        if day == 3:
            assert out.where("change = 'changed'").first().changed_fields == ["title"]
        allowed = spark.createDataFrame([("c",)] if complete else [], "company string")
        state = lifecycle.sync(out.drop("change"), b.select("company", "job_id"), allowed).cache()
        assert {r.job_id for r in state.collect()} == ({"1", "2", "3"} if day < 3 else {"1", "2", "3", "4"} if day < 5 else {"1", "2", "4"})
    assert {r.first_seen.day for r in state.where("job_id = '1'").collect()} == {1}


def test_collapse(spark):
    cases = [(138, 4, True), (100, 49, True), (100, 50, False), (0, 0, False), (None, 5, False), (6, 2, False), (19, 0, False), (20, 0, True)]
    df = spark.createDataFrame(cases, "p int, n int, want boolean")
    assert df.where(lifecycle.collapsed(F.col("p"), F.col("n")) != F.col("want")).count() == 0


def test_dedup(spark):
    rows = [(1, "u1", "id1", 0), (2, "u1", "id1", 1), (3, "u2", "id1", 0), (4, "u3", None, 0), (5, "u4", "", 0), (6, "u4", "", 0)]
    df = spark.createDataFrame(rows, "seq long, url string, job string, q int")
    out = dedup.two_passes(df, F.col("url"), F.col("job"), F.col("url"), [F.col("q")])
    assert sorted((r.seq, r.url, r.q) for r in out.collect()) == [(1, "u1", 1), (4, "u3", 0), (5, "u4", 0)]
    df = spark.createDataFrame([(1, "a", ""), (2, "a", ""), (3, "a", "x"), (4, "a", "x"), (5, "b", "x")], "seq long, company string, url string")
    assert sorted(r.seq for r in dedup.first_of_each(df, ["company"], "url").collect()) == [1, 2, 3, 5]


def test_merge(spark):
    schema = "job_id string, company string, seq long, run string"
    prev = spark.createDataFrame([("a1", "a", 1, "old"), ("a2", "a", 2, "old"), ("g9", "g", 3, "old")], schema)
    fresh = spark.createDataFrame([("a3", "a", 1, "new"), ("a2", "a", 2, "new")], schema)
    told = lambda s, c: spark.createDataFrame([("a", s, c)], "company string, success boolean, authoritative boolean")
    got = lambda t: [(r.job_id, r.run) for r in merge.merge_rows(prev, fresh, t).orderBy("place").collect()]
    assert got(told(True, True)) == [("g9", "old"), ("a3", "new"), ("a2", "new")]
    assert got(told(True, False)) == [("a1", "old"), ("a2", "new"), ("g9", "old"), ("a3", "new")]
    assert got(told(False, False)) == [("a1", "old"), ("a2", "old"), ("g9", "old")]


def test_merge_leaves_one_row_an_id(spark):
    """As a fold over the rows: the last previous place of an id takes the last fresh row of it."""
    rng = random.Random(8)
    schema = "job_id string, company string, seq long, run string"
    for _ in range(3):
        make = lambda run, n: [(rng.choice([None, "", *"abcdefg"]), rng.choice("xyz"), i, f"{run}{i}") for i in range(n)]
        prev, fresh, told = make("old", 14), make("new", 10), {"x": (True, True), "y": (True, False), "z": (False, False)}
        want, at = [], {}
        for job, company, _, run in prev:
            if told[company] != (True, True):
                if job:
                    at[job] = len(want)
                want.append((job, company, run))
        for job, company, _, run in fresh:
            if told[company][0]:
                if job in at:
                    want[at[job]] = job, company, run
                else:
                    if job:
                        at[job] = len(want)
                    want.append((job, company, run))
        df = spark.createDataFrame([(c, *v) for c, v in told.items()], "company string, success boolean, authoritative boolean")
        out = merge.merge_rows(spark.createDataFrame(prev, schema), spark.createDataFrame(fresh, schema), df)
        assert [(r.job_id, r.company, r.run) for r in out.orderBy("place").collect()] == want


def test_walk(spark):
    pages = [("t", k, list(range(20 * k, min(95, 20 * k + 20))), 95, False) for k in range(5)]
    pages += [("n", k, list(range(20 * k, min(50, 20 * k + 20))), None, False) for k in range(3)]
    pages += [("r", k, [1, 2, 3], 9, False) for k in range(3)] + [("f", 0, [1, 2], 9, False), ("f", 1, None, 9, True)]
    df = spark.createDataFrame(pages, "source string, page_no int, rows array<int>, total int, failed boolean")
    out = {r.source: r for r in walk.walk(df).collect()}
    assert (out["t"].collected, out["t"].stop_reason, out["t"].complete, out["t"].pages) == (95, "reported_total_reached", True, 5)
    assert (out["n"].collected, out["n"].stop_reason, out["n"].complete) == (50, "exhausted", True)
    assert (out["r"].collected, out["r"].stop_reason, out["r"].complete, out["r"].shortfall) == (3, "repeated_page", False, 6)
    assert (out["f"].collected, out["f"].stop_reason, out["f"].complete) == (2, "page_failed", False)


def test_walk_is_dealt_by_its_rows(spark):
    """Tasks follow the keys, however small the shuffled bytes are; rows are counted where nobody tells them."""
    pages = [(s, p, [p * 3, p * 3 + 1, None] if p % 5 else [0, 1], 9 if s % 2 else None, s == 7 and p == 2) for s in range(40) for p in range(6)]
    df = spark.createDataFrame(pages, "source long, page_no int, rows array<long>, total long, failed boolean")
    few, many = walk.walk(df), walk.walk(df, rows=10 * walk.TASK_ROWS)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and many.rdd.getNumPartitions() == 10
    want = {s: (4, "page_failed") if s == 7 else (10, "reported_total_reached" if s % 2 else "repeated_page") for s in range(40)}
    for out in (few, many):
        assert {r.source: (r.collected, r.stop_reason) for r in out.collect()} == want


def test_walk_beyond_its_ceiling(spark):
    """Pages after the ceiling change nothing."""
    pages = [(s, p, [p], None, False) for s in (1, 2) for p in range(walk.MAX_PAGES + (5 if s == 1 else -1))]
    df = spark.createDataFrame(pages, "source long, page_no int, rows array<long>, total long, failed boolean")
    out = {r.source: (r.pages, r.collected, r.stop_reason) for r in walk.walk(df).collect()}
    assert out == {1: (walk.MAX_PAGES, walk.MAX_PAGES, "page_ceiling"), 2: (walk.MAX_PAGES - 1, walk.MAX_PAGES - 1, "exhausted")}
