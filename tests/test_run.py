import datetime as dt

from pyspark.sql import functions as F

from harrow import schemas as S
from harrow.functions import providers
from harrow.operators import hints
from harrow.operators.store import Store
from harrow.plans import run as R
from harrow.streaming import upserts

RAW = "company string, title string, location string, date_posted timestamp, job_url string, apply_url string, employment_type string, remote boolean, description string, ats_provider string, scraping_method string, seq long"
T = dt.datetime


def raw(spark, *rows):
    return spark.createDataFrame([(c, t, p, d, u, None, None, None, "python and sql", "unknown", m, i) for i, (c, t, p, d, u, m) in enumerate(rows)], RAW)


def test_run(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", S.STATE)
    day = T(2024, 1, 10)
    first = raw(spark, ("A", "Data  Engineer", "Dallas, TX", day, "https://a/1?jobId=1", "playwright"), ("A", "Data Engineer", "Dallas, TX", day, "https://a/x?jobId=1", "direct_api"), ("A", "Cook", "Dallas, TX", day, "https://a/2?jobId=2", "x"), ("A", None, "Dallas", day, "https://a/3", "x"), ("B", "ETL Developer", "Remote", None, "https://b/9?jobId=9", "x"), ("B", "Data Engineer", "Remote", T(2023, 1, 1), "https://b/8?jobId=8", "x"))
    results = spark.createDataFrame([("A", True, True, 2, None), ("B", True, True, 1, None)], "company string, success boolean, complete boolean, jobs int, previous int")
    out = {r.job_id: r for r in R.run(first, results, store, F.lit(day)).collect()}
    assert set(out) == {"a:1", "b:9"} and out["a:1"].scraping_method == "direct_api" and out["a:1"].title == "Data Engineer"
    assert (out["a:1"].change_status, out["a:1"].date_filter_status, out["b:9"].date_filter_status) == ("new", S.WITHIN, S.UNDATED)
    assert out["a:1"].fit_matched == "python, sql" and store.current()[0] == 1 and store.read().count() == 4
    again = raw(spark, ("A", "Senior Data Engineer", "Dallas, TX", day, "https://a/1?jobId=1", "direct_api"))
    for n in (2, 3):
        out = R.run(again, results, store, F.lit(T(2024, 1, 10 + n))).collect()
    assert {r.job_id for r in store.read().collect()} == {"a:1"} and out[0].change_status == "unchanged"
    assert Store(spark, f"file://{tmp_path}/s", S.STATE, scheme=4).read().count() == 0


def test_copies_are_chosen_after_filters(spark, tmp_path):
    """A copy that fails a filter never hides one that passes; dated copies beat direct ones."""
    store, day = Store(spark, f"file://{tmp_path}/s", S.STATE), T(2024, 1, 10)
    rows = raw(spark, ("A", "Cook", "Dallas, TX", day, "https://a/1?jobId=1", "direct_api"), ("A", "Data Engineer", "Dallas, TX", day, "https://a/x?jobId=1", "playwright"), ("A", "Data Engineer", "Dallas, TX", None, "https://a/2?jobId=2", "direct_api"), ("A", "Data Engineer", "Dallas, TX", day, "https://a/y?jobId=2", "playwright"))
    results = spark.createDataFrame([("A", True, True, 4, None)], "company string, success boolean, complete boolean, jobs int, previous int")
    out = {r.job_id: r for r in R.run(rows, results, store, F.lit(day)).collect()}
    assert set(out) == {"a:1", "a:2"} and out["a:1"].title == "Data Engineer" and out["a:2"].date_posted == day
    assert store.read().count() == 2
    tied = rows.where("seq in (1, 3)").withColumn("job_url", F.lit("https://a/1?jobId=1")).withColumn("description", F.when(F.col("seq") == 1, "short").otherwise("a longer text"))
    assert [r.seq for r in R.best(R.build(tied)).collect()] == [1] and R.best(R.build(tied)).first().description == "short"


def test_stream_equals_batches(spark, tmp_path):
    from harrow.operators import lifecycle

    schema = "job_id string, job_url string, company string, title string, location string, date_posted timestamp, seq long"
    store, batch = Store(spark, f"file://{tmp_path}/s", S.STATE), Store(spark, f"file://{tmp_path}/b", S.STATE)
    for k in range(3):
        rows = [(str(i), f"u{i}", "c", f"t{i * k % 3}", "x", T(2024, 1, 1 + k), i) for i in range(k, k + 3)]
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        upserts.start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), store, f"file://{tmp_path}/cp", time="date_posted").awaitTermination()
        batch.commit(lifecycle.upsert(batch.read(), df, F.lit(T(2024, 1, 1 + k))).drop("change"))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, batch.read().collect()))


def test_hints(spark):
    day, today = dt.date(2024, 1, 1), F.lit(dt.date(2024, 2, 1))
    state = spark.createDataFrame([("a", "u", None, day, 10, 0, True, False, None), ("b", "u", None, day, 10, 0, False, False, None), ("c", "u", None, day, 10, 1, True, False, None), ("d", "u", None, day, 10, 0, True, False, None), ("e", "u", None, day, 5, 0, True, False, None)], hints.STATE)
    out = spark.createDataFrame([("a", "clean_failure", None, None, 0, True), ("b", "clean_failure", None, None, 0, True), ("c", "transient", None, None, 0, True), ("d", "blocked", None, None, 0, True), ("e", "success", "v", None, 7, True), ("f", "success", "w", None, 3, False), ("g", "transient", None, None, 0, False)], "company string, outcome string, entry_url string, json_endpoint string, jobs long, from_hint boolean")
    got = {r.company: r for r in hints.step(state, out, today).collect()}
    assert set(got) == {"b", "d", "e", "f"} and got["b"].unsupported and got["b"].entry_url is None and got["b"].checked_at == dt.date(2024, 2, 1)
    assert got["d"].consecutive_failures == 0 and (got["e"].entry_url, got["e"].jobs_last_seen, got["e"].proven) == ("v", 7, True) and got["f"].proven is False
    use = {r.company: r.u for r in hints.step(state, out, today).select("company", hints.usable(F.lit(dt.date(2024, 2, 2))).alias("u")).collect()}
    assert use == {"b": False, "d": False, "e": True, "f": True}
    cases = [(0, 0, True, [], 0, False), (1, 0, True, [], 0, True), (1, 0, False, ["page_ceiling"], 0, True), (1, 0, False, ["page_failed"], 3, True), (1, 0, False, ["page_failed"], 4, False), (1, 0, False, ["page_failed"], None, False), (1, 0, False, [], None, False)]
    df = spark.createDataFrame(cases, "n int, c int, ok boolean, r array<string>, u int, want boolean")
    assert df.where(hints.may_send(F.col("n"), F.col("c"), F.col("ok"), F.col("r"), F.col("u")) != F.col("want")).count() == 0
    least = spark.createDataFrame([(None, 1), (0, 1), (10, 8), (1, 1)], "x long, want long")
    assert least.where(hints.least_rows(F.col("x")) != F.col("want")).count() == 0


def test_providers(spark):
    df = spark.createDataFrame([("https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/x", "workday", "acme", "Careers"), ("https://boards.greenhouse.io/acme/jobs/1", "greenhouse", "acme", None), ("https://acme.icims.com/jobs", "icims", "acme", None), ("https://acme.com/jobs", None, None, None)], "u string, p string, t string, s string")
    for r in df.select("p", "t", "s", providers.coordinates(F.col("u")).alias("c")).collect():
        assert (r.c.provider, r.c.tenant, r.c.site) == (r.p, r.t, r.s)
    assert [r[0] for r in spark.createDataFrame([("<a href=X.icims.com>",), ("x",)], "h string").select(providers.by_markup(F.col("h"))).collect()] == ["icims", None]


def test_stage_counts_come_from_the_runs_own_pass(spark, tmp_path):
    from harrow.functions import dates, matching
    from harrow.operators import report

    titles, places = ["Data Engineer", "Chef", None, "ETL Developer"], ["Dallas, TX", "Paris, France", "Remote"]
    days = [T(2024, 1, 28), T(2023, 10, 1), None]
    raw = spark.createDataFrame([("c", titles[i % 4], places[i % 3], days[i // 2 % 3], f"https://x.example/{i}", None, None, None, "python", "lever", "direct_api", i) for i in range(120)], S.RECORD + ", seq long")
    told = spark.createDataFrame([("c", True, True, 120, 100)], "company string, success boolean, complete boolean, jobs long, previous long")
    now, stages = F.lit(T(2024, 1, 29)).cast("timestamp"), R.Stages()
    R.run(raw, told, Store(spark, f"file://{tmp_path}/s", S.STATE), now, stages=stages)
    records = R.build(raw)
    status, _ = dates.freshness(F.col("date_posted"), F.lit(None).cast("timestamp"), now)
    flags = records.select(matching.role(F.col("title")).alias("role"), matching.location_match(F.col("location"), F.col("title"), F.col("remote")).isNotNull().alias("place"), status.alias("status"))
    want = report.stage_counts(flags).first().asDict()
    assert stages.counts() == want and 0 < want["within_window"] < want["location_match"] < want["target_role"] < want["collected"]
