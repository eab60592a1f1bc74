import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from harrow import schemas as S
from harrow.operators import report
from harrow.operators.store import Store
from harrow.sinks import exports
from harrow.sources import files

JOB = "job_id string, company string, title string, date_posted string, job_url string, seq long"
JOBS = [("1", "A", "=1+1", "2024-01-02", "u1", 0), ("2", "B", 'say "x", y', None, "u2", 1), ("3", "A", " two\nlines ", "2024-01-10", "u3", 2), ("4", "C", None, "2024-01-02", "u4", 3)]


def test_exports(spark, tmp_path):
    at = f"file://{tmp_path}/out"
    jobs = spark.createDataFrame(JOBS, JOB)
    exports.write_postings(jobs, at, "20240101T000000Z", raw=jobs)
    table = files.text_table(spark, f"{at}/postings.csv")
    assert table.columns == list(exports.POSTINGS)
    names = sorted(p for p in (tmp_path / "out/postings.csv").iterdir() if p.name.startswith("part-"))
    ordered = [r.job_url for p in names for r in files.text_table(spark, f"file://{p}").collect()]
    assert ordered == ["u3", "u1", "u4", "u2"]
    got = {r.job_url: (r.title, r.date_posted, r.run_id) for r in table.collect()}
    assert got == {"u1": ("'=1+1", "2024-01-02", "20240101T000000Z"), "u2": ('say "x", y', "", "20240101T000000Z"), "u3": (" two\nlines ", "2024-01-10", "20240101T000000Z"), "u4": ("", "2024-01-02", "20240101T000000Z")}
    back = files.json_rows(spark, f"{at}/postings.json", JOB).orderBy("seq").collect()
    assert [tuple(r) for r in back] == JOBS
    assert sorted(r.title for r in files.text_table(spark, f"{at}/raw.csv").collect()) == ["", " two\nlines ", "=1+1", 'say "x", y']


def test_merged_report(spark, tmp_path):
    schema = "company string, success boolean, complete boolean, blocked boolean, jobs long, reported_total long, planned_method string, actual_method string, stop_reason string, error_type string, error_message string, seconds double"
    old = spark.createDataFrame([("A", True, True, False, 40, None, "api", None, None, None, None, 1.0), ("B", True, True, None, 5, None, "api", None, None, None, None, 1.0)], schema)
    new = spark.createDataFrame([("A", True, True, False, 4, 9, "api", "browser", "x", None, "e" * 900, 1.23456)], schema)
    exports.write_report(exports.report_rows(old), f"file://{tmp_path}/1", "r1")
    shape = "company string, method string, jobs long, reported_total long, complete boolean, stop_reason string, status string, error_type string, error_message string, duration_seconds double, previous_jobs long, removal_sync_allowed boolean, collapsed_vs_previous boolean, run_id string"
    last = files.json_rows(spark, f"file://{tmp_path}/1", shape)
    exports.write_report(exports.report_rows(new, last.select("company", "jobs")), f"file://{tmp_path}/2", "r2", last)
    got = {r.company: r for r in files.json_rows(spark, f"file://{tmp_path}/2", shape).collect()}
    assert (got["A"].run_id, got["A"].method, got["A"].previous_jobs, got["A"].collapsed_vs_previous, got["A"].removal_sync_allowed, got["A"].duration_seconds, len(got["A"].error_message)) == ("r2", "browser", 40, True, False, 1.23, 300)
    assert (got["B"].run_id, got["B"].jobs, got["B"].removal_sync_allowed) == ("r1", 5, True)


def test_tolerant_scans(spark, tmp_path):
    put = lambda name, text: ((tmp_path / name).write_text(text), f"file://{tmp_path}/{name}")[1]
    nowhere = f"file://{tmp_path}/none"
    good, bad = put("a.json", '[{"a": 1, "b": "x"},\n {"a": 2}]'), put("b.json", '[{"a": 1}, {"a"')
    assert [tuple(r) for r in files.json_rows(spark, good, "a long, b string", lines=False).collect()] == [(1, "x"), (2, None)]
    assert files.json_rows(spark, bad, "a long", lines=False).count() == 0 and files.json_rows(spark, nowhere, "a long").count() == 0
    lines = put("c.json", '{"a": 1}\n{bad\n{"a": 3}\n')
    assert [r.a for r in files.json_rows(spark, lines, "a long").collect()] == [1, 3]
    table = put("d.csv", "x,y\nNA,\n1,nan\n")
    assert [tuple(r) for r in files.text_table(spark, table, ("y", "x", "z")).collect()] == [("", "NA", ""), ("nan", "1", "")]
    assert files.text_table(spark, nowhere, ("x",)).count() == 0 and files.text_table(spark, nowhere).columns == []
    whole = put("e.json", json.dumps({"run_id": "r", "companies": [{"company": "A", "jobs": 3}]}))
    assert [r.companies[0].jobs for r in files.document(spark, whole, "run_id string, companies array<struct<company string, jobs long>>").collect()] == [3]
    for text in ("[1, 2]", '{"run_id": ', "", "null"):
        assert files.document(spark, put("f.json", text), "run_id string").count() == 0
    assert files.document(spark, nowhere, "run_id string").count() == 0
    hints = put("g.json", json.dumps({"A": {"entry_url": "u", "proven": True}, "B": 5, "C": {}}))
    assert sorted((r.company, r.entry_url, r.proven) for r in files.hints(spark, hints).collect()) == [("A", "u", True), ("C", None, None)]
    assert files.hints(spark, put("h.json", "{oops")).count() == 0 and files.hints(spark, nowhere).count() == 0
    book = spark.createDataFrame([(" Acme ", None), ("nan", "x"), (None, "y")], "Name string, ATS string")
    assert [tuple(r) for r in files.workbook_cells(book, "Name", "ATS", "Gone").collect()] == [("Acme", "", "")]


def test_log(spark, tmp_path):
    log = """INFO ats.router: Early -> workday
INFO pipeline: Executing 3 companies
INFO ats.router: Acme Corp -> greenhouse (direct)
INFO ats.router: Other -> lever
noise
INFO ats.router: Acme Corp -> 12 jobs retrieved
"""
    (tmp_path / "run.log").write_text(log)
    lines = files.log_lines(spark, f"file://{tmp_path}/run.log")
    assert [r.line for r in lines.orderBy("line_no").collect()] == log.splitlines()
    r = files.progress(lines).first()
    assert (r.total, r.started, r.finished, r.current, r.provider) == (3, 2, 1, "Acme Corp", "greenhouse (direct)")
    assert [x.line for x in files.tail(lines, 2).orderBy("line_no").collect()] == log.splitlines()[-2:]
    assert files.progress(files.log_lines(spark, f"file://{tmp_path}/none")).count() == 0


class Stop(Exception):
    pass


def row(k):
    return [(str(k), "u", "c", "t", "x", dt.datetime(2024, 1, k), None, None, 0, None, None, None)]


def test_a_stop_at_any_step_of_a_commit_keeps_the_last_version(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    ids = lambda: [r.job_id for r in Store(spark, root, S.STATE).read().collect()]
    for k in (1, 2, 3):
        assert Store(spark, root, S.STATE).commit(spark.createDataFrame(row(k), S.STATE)) == k
    assert ids() == ["3"]

    class Halting:
        """The file system, which stops at its n-th change."""

        def __init__(self, fs, n):
            self.fs, self.left = fs, n

        def __getattr__(self, name):
            found = getattr(self.fs, name)
            if name not in ("create", "rename", "delete"):
                return found

            def call(*a):
                self.left -= 1
                if self.left < 0:
                    raise Stop
                return found(*a)

            return call

    seen = []
    for n in (0, 1, 2, 5, 40):
        store = Store(spark, root, S.STATE)
        store._fs = Halting(store._fs, n)
        before = ids()
        try:
            store.commit(spark.createDataFrame(row(4 + n % 20), S.STATE))
            stopped = False
        except Stop:
            stopped = True
        now = ids()
        assert now == [str(4 + n % 20)] or (stopped and now == before), (n, now)
        seen.append((stopped, now == before))
    assert (True, True) in seen and (True, False) in seen and (False, False) in seen
    # data without a pointer is no version, and the next commit takes its place
    spark.createDataFrame(row(9), S.STATE).write.mode("overwrite").parquet(f"{root}/v={Store(spark, root, S.STATE).current()[0] + 1}")
    before = ids()
    assert ids() == before and Store(spark, root, S.STATE).commit(spark.createDataFrame(row(20), S.STATE)) and ids() == ["20"]


def test_two_writers(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    a, b = Store(spark, root, S.STATE), Store(spark, root, S.STATE)
    a.commit(spark.createDataFrame(row(1), S.STATE))
    with pytest.raises(OSError):
        b._publish(1)
    assert a.current() == b.current() == (1, 3)


def test_ranked_without_a_global_window(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), "id")
    got = report.ranked(df, [F.asc("x")], "id").collect()
    assert sorted((r.x, r["rank"]) for r in got) == [(i, i + 1) for i in range(1000)]
    assert [r.x for r in report.ranked(df, [F.asc("x")], "id", most=3).collect()] == [0, 1, 2]
    assert report.ranked(df.limit(0), [F.asc("x")], "id").count() == 0


def test_report_document(spark, tmp_path):
    """One JSON document, valid as a whole, that gives back the flat table line by line."""
    import json

    from pyspark.sql import functions as F

    from harrow.sinks import exports

    schema = "company string, method string, jobs long, status string, error_message string"
    now = F.lit("2024-02-01").cast("timestamp")
    for rows in ([], [("a", "m", 1, "ok", None)], [(f"c{i % 7}", "m" if i % 2 else None, i, "ok" if i % 3 else "failed", 'quote " and, comma' if i % 5 == 0 else None) for i in range(200)]):
        flat, at = spark.createDataFrame(rows, schema).repartition(3), f"file://{tmp_path}/d{len(rows)}"
        exports.write_document(flat, at, "r1", now, flat.agg(F.count("*").alias("jobs_collected")))
        text = "".join(p.read_text() for p in sorted((tmp_path / f"d{len(rows)}").glob("part-*")))
        doc = json.loads(text)
        assert doc["companies_attempted"] == len(rows) == len(doc["companies"]) == doc["totals"]["jobs_collected"] and doc["generated_at"] == "2024-02-01T00:00:00+00:00"
        assert doc["status_counts"].get("ok", 0) == sum(r[3] == "ok" for r in rows) and set(doc["method_counts"]) <= {"m"}
        assert [c["company"] for c in doc["companies"]] == sorted(r[0] for r in rows)
        assert sorted(map(str, files.report_companies(spark, at, schema).collect())) == sorted(map(str, flat.collect()))
    assert files.report_companies(spark, f"file://{tmp_path}/none", schema).count() == 0
