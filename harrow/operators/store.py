"""A versioned store: each commit writes a new folder, then a pointer file that names it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Snapshots under root/v=N, each made visible by the file root/CURRENT-N; one writer at a time.

    A pointer is written beside its place and renamed into it, and never changed or replaced: the
    largest one is the current version. A stop at any step leaves the version before, whole; a writer
    that lost a race fails on the rename. Files go through Hadoop's file systems, so the root may be
    any path that Spark reads and whose renames are atomic."""

    def __init__(self, spark: SparkSession, root: str, schema: str, scheme: int = 3):
        self.spark, self.root, self.schema, self.scheme = spark, root.rstrip("/"), schema, scheme
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[tuple[int, int]]:
        """(version, scheme) of all commits still there, in order."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))]
        found = [n.split("-")[1:] for n in names if n.startswith("CURRENT-")]
        return sorted((int(v), int(s)) for v, s in found)

    def current(self) -> tuple[int, int]:
        """(version, scheme of its ids); (0, own scheme) before the first commit."""
        return next(reversed(self._pointers()), (0, self.scheme))

    def read(self) -> DataFrame:
        """The current snapshot; empty before the first commit, or when the ids' format has changed."""
        version, scheme = self.current()
        if not version or scheme != self.scheme:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/v={version}")

    def commit(self, df: DataFrame, keep: int = 2) -> int:
        """Write df as the next version; of older ones the last `keep` - 1 stay for their readers."""
        version = self.current()[0] + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v={version}")
        self._publish(version)
        for old, scheme in self._pointers():
            if old <= version - keep:
                self._fs.delete(self._path(f"{self.root}/CURRENT-{old:012d}-{scheme}"), False)
                self._fs.delete(self._path(f"{self.root}/v={old}"), True)
        return version

    def _publish(self, version: int) -> None:
        new, now = self._path(f"{self.root}/.next-{version}"), self._path(f"{self.root}/CURRENT-{version:012d}-{self.scheme}")
        self._fs.create(new, True).close()
        if self._fs.exists(now) or not self._fs.rename(new, now):
            raise OSError(f"version {version} was committed by another writer")
