import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from harrow import schemas as S
from harrow.operators import lifecycle
from harrow.operators.buckets import BucketStore
from harrow.operators.store import Store
from harrow.plans import run as R
from harrow.streaming import upserts

NOW = lambda: F.lit("2024-02-01").cast("timestamp")
ROW = "job_id string, job_url string, company string, title string, location string, date_posted timestamp, seq long"


def state(spark, companies, per=20):
    return spark.range(companies * per).select(
        F.concat(F.lit("j"), "id").alias("job_id"), F.concat(F.lit("u"), "id").alias("job_url"), F.concat(F.lit("c"), (F.col("id") % companies).cast("string")).alias("company"), F.lit("t").alias("title"), F.lit("x").alias("location"),
        F.lit("2024-01-01").cast("timestamp").alias("first_seen"), F.lit("2024-01-01").cast("timestamp").alias("last_seen"), F.lit(None).cast("timestamp").alias("date_posted"), F.lit(0).alias("misses"), F.sha2(F.col("id").cast("string"), 256).alias("record_hash"), F.lit(None).cast("timestamp").alias("changed_at"), F.lit(None).cast("array<string>").alias("changed_fields"),
    )


def rows(df):
    return sorted(map(str, df.collect()))


def bytes_of(path):
    return {str(p): p.stat().st_size for p in pathlib.Path(path).rglob("part-*.parquet")}


def test_a_commit_rewrites_only_touched_buckets(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store, whole = BucketStore(spark, root, S.STATE, buckets=200), Store(spark, f"file://{tmp_path}/w", S.STATE)
    base = state(spark, 400)
    store.commit(base)
    whole.commit(base)
    before = bytes_of(tmp_path / "s")
    batch = spark.createDataFrame([(f"j{k}", f"u{k}x", "c3", "new", "y", None, k) for k in (3, 403, 99999)] + [("j5", "u5", "c5", "t", "x", None, 9)], ROW)
    assert store.update(batch.select("company"), lambda s: lifecycle.upsert(s, batch, NOW()).drop("change")) == 2
    whole.commit(lifecycle.upsert(whole.read(), batch, NOW()).drop("change"))
    fresh = {p: n for p, n in bytes_of(tmp_path / "s").items() if p not in before}
    assert 0 < sum(fresh.values()) <= 0.02 * sum(before.values()) + 2 * max(before.values())
    assert rows(store.read()) == rows(whole.read())
    # two of four hundred companies may remove: again only their buckets
    allowed = spark.createDataFrame([("c3",), ("c5",)], "company string")
    for _ in range(2):
        store.update(allowed, lambda s: lifecycle.sync(s, batch.select("company", "job_id"), allowed))
        whole.commit(lifecycle.sync(whole.read(), batch.select("company", "job_id"), allowed))
    assert rows(store.read()) == rows(whole.read()) and store.read().count() < 400 * 20
    # buckets that become empty are named no more, and old versions' files go once nothing names them
    store.update(spark.createDataFrame([("c7",)], "company string"), lambda s: s.where("company = 'none'"))
    assert store.read().where("company = 'c7'").isEmpty()
    named = {f"v={v}/bucket={b}" for n, s in store._pointers() for b, v in store._manifest(n, s)["buckets"].items()}
    there = {f"{p.parent.name}/{p.name}" for p in (tmp_path / "s").glob("v=*/bucket=*") if any(p.glob("part-*"))}
    assert there == named and len(store._pointers()) == 2


def test_rows_of_other_buckets_are_refused(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/s", S.STATE, buckets=50)
    store.commit(state(spark, 20, 2))
    before = rows(store.read())
    with pytest.raises(Exception, match="touched bucket"):
        store.update(spark.createDataFrame([("c1",)], "company string"), lambda s: state(spark, 20, 2))
    assert rows(store.read()) == before and store.current()[0] == 1
    with pytest.raises(ValueError):
        BucketStore(spark, f"file://{tmp_path}/s", S.STATE, buckets=51).read()


def test_a_stop_at_any_step_keeps_the_last_version(spark, tmp_path):
    class Stop(Exception):
        pass

    class Halting:
        def __init__(self, fs, n):
            self.fs, self.left = fs, n

        def __getattr__(self, name):
            found = getattr(self.fs, name)

            def call(*a):
                self.left -= 1
                if self.left < 0:
                    raise Stop
                return found(*a)

            return call if name in ("create", "rename", "delete") else found

    root = f"file://{tmp_path}/s"
    fresh = lambda: BucketStore(spark, root, S.STATE, buckets=16)
    fresh().commit(state(spark, 8, 2))
    key = spark.createDataFrame([("c1",)], "company string")
    ended = set()
    for n in (0, 1, 2, 3, 50):
        store = fresh()
        store._fs = Halting(store._fs, n)
        before, want = rows(fresh().read()), rows(fresh().read().withColumn("title", F.when(F.col("company") == "c1", F.lit(f"n{n}")).otherwise(F.col("title"))))
        own = store.touched(key)
        try:
            store.update(key, lambda s, n=n: s.withColumn("title", F.when(F.col("company") == "c1", F.lit(f"n{n}")).otherwise(F.col("title"))))
            ended.add("whole")
            assert rows(fresh().read()) == want and own
        except Stop:
            now = rows(fresh().read())
            assert now in (before, want)
            ended.add("before" if now == before else "after")
    assert ended == {"whole", "before", "after"}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/s", S.STATE, buckets=8)
    for k in range(3):
        spark.createDataFrame([(f"j{i}", f"u{i}", f"c{i % 3}", f"t{k}", "x", None, i) for i in range(k, k + 4)], ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        upserts.start(spark.readStream.schema(ROW).parquet(f"{tmp_path}/in"), store, f"file://{tmp_path}/cp").awaitTermination()
    files, held = bytes_of(tmp_path / "s"), rows(store.read())
    # the query's own record of its last batch is lost, as when it stops between commit and record
    newest = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    upserts.start(spark.readStream.schema(ROW).parquet(f"{tmp_path}/in"), store, f"file://{tmp_path}/cp").awaitTermination()
    assert bytes_of(tmp_path / "s") == files and rows(store.read()) == held and store.last_batch("stream") == 2


def test_a_run_is_the_same_with_either_store(spark, tmp_path):
    schema = S.RECORD + ", seq long"
    day = lambda n: dt.datetime(2024, 1, n)
    raw = lambda k: spark.createDataFrame([(f"c{i % 4}", "Data Engineer", "Dallas, TX", day(28), f"https://x.example/{i}", None, None, None, "python", "lever", "direct_api", i) for i in range(k, 12)], schema)
    told = lambda k: spark.createDataFrame([(f"c{i}", True, True, 3, 3) for i in range(k, 4)], "company string, success boolean, complete boolean, jobs long, previous long")
    a, b = Store(spark, f"file://{tmp_path}/a", S.STATE), BucketStore(spark, f"file://{tmp_path}/b", S.STATE, buckets=8)
    for k in (0, 3, 3):
        now = F.lit(day(29)).cast("timestamp")
        assert rows(R.run(raw(k), told(k), a, now)) == rows(R.run(raw(k), told(k), b, now))
        assert rows(a.read()) == rows(b.read())
