"""A store in buckets: a commit rewrites only the buckets whose keys it touches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

BUCKETS = 256


class BucketStore(Store):
    """Rows dealt to buckets by a hash of `key`, under root/v=N/bucket=B; each version has a manifest,
    root/CURRENT-N, that names the version which holds each bucket that is not empty. A commit writes the
    touched buckets below its own version and a manifest that takes the others from the one before, in
    the same two steps as Store: a stop anywhere leaves the version before, whole.

    The driver holds one number a bucket, whatever the rows. A key's rows may be many: the writer's
    partitions are split by size, so that a bucket may have several files."""

    def __init__(self, spark: SparkSession, root: str, schema: str, scheme: int = 3, key: str = "company", buckets: int = BUCKETS):
        super().__init__(spark, root, schema, scheme)
        self.key, self.buckets = key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _pointer(self, version: int, scheme: int) -> str:
        return f"{self.root}/CURRENT-{version:012d}-{scheme}"

    def _manifest(self, version: int, scheme: int) -> dict:
        """{"buckets": {bucket: version}, "batches": {stream: last batch}, "of": number of buckets}"""
        lines = self.spark.read.text(self._pointer(version, scheme), wholetext=True).collect()
        return json.loads(lines[0][0])

    def manifest(self) -> dict:
        version, scheme = self.current()
        empty = {"buckets": {}, "batches": {}, "of": self.buckets}
        if not version or scheme != self.scheme:
            return empty
        found = self._manifest(version, scheme)
        if found["of"] != self.buckets:
            raise ValueError(f"the store has {found['of']} buckets")
        return found

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def _rows(self, held: dict) -> DataFrame:
        paths = [f"{self.root}/v={v}/bucket={b}" for b, v in held.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The current snapshot, or only those buckets of it."""
        held = self.manifest()["buckets"]
        return self._rows(held if buckets is None else {b: v for b, v in held.items() if int(b) in set(buckets)})

    def commit(self, df: DataFrame, keep: int = 2, buckets: list[int] | None = None, batch: tuple[str, int] | None = None) -> int:
        """df replaces the rows of these buckets (of all, if not told): all its keys must be in them.
        batch: a stream's name and batch, remembered with the version."""
        before, version = self.manifest(), self.current()[0] + 1
        new, at = df.withColumn("bucket", self.bucket()), f"{self.root}/v={version}"
        if buckets is not None:
            new = new.withColumn("bucket", F.when(F.col("bucket").isin(buckets), F.col("bucket")).otherwise(F.raise_error(F.lit("a row's key is in no touched bucket")).cast("int"))) if buckets else new.limit(0)
        new.select(*[c for c in df.columns], "bucket").hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        written = [f.getPath().getName() for f in self._fs.listStatus(self._path(at))]
        held = {b: v for b, v in before["buckets"].items() if buckets is not None and int(b) not in set(buckets)}
        held |= {n.split("=")[1]: version for n in written if n.startswith("bucket=")}
        batches = before["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._publish(version, json.dumps({"buckets": held, "batches": batches, "of": self.buckets}))
        self._drop(version - keep)
        return version

    def update(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        """The rows in the buckets of these keys become what change() makes of them; the rest is not read."""
        own = self.touched(keys)
        return self.commit(change(self.read(own)), buckets=own, batch=batch)

    def last_batch(self, stream: str) -> int:
        return self.manifest()["batches"].get(stream, -1)

    def _publish(self, version: int, manifest: str = "") -> None:
        new, now = self._path(f"{self.root}/.next-{version}"), self._path(self._pointer(version, self.scheme))
        out = self._fs.create(new, True)
        out.write(bytearray(manifest.encode()))
        out.close()
        if self._fs.exists(now) or not self._fs.rename(new, now):
            raise OSError(f"version {version} was committed by another writer")

    def _drop(self, last: int) -> None:
        """Remove versions up to `last`, and of their folders the buckets that no later version names."""
        every = self._pointers()
        used = {(v, int(b)) for n, s in every if n > last for b, v in self._manifest(n, s)["buckets"].items()}
        for old, scheme in every:
            if old <= last:
                gone = {(v, int(b)) for b, v in self._manifest(old, scheme)["buckets"].items()} - used
                self._fs.delete(self._path(self._pointer(old, scheme)), False)
                for v, b in gone:
                    self._fs.delete(self._path(f"{self.root}/v={v}/bucket={b}"), True)
