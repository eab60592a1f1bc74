"""What the operators share: written cuts of the lineage, hashed words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch; with 3 KB a text, a batch takes a few MB.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Long texts: hand Python fewer rows at a time than Spark's 10,000, and no more than BATCH_BYTES
    beside one row. Spark reads these settings from the session when a job starts, so they stay there;
    a caller's smaller ones are kept."""
    now = spark._jsparkSession.sessionState().conf()
    for name, held, most in (("maxRecordsPerBatch", now.arrowMaxRecordsPerBatch(), BATCH_ROWS), ("maxBytesPerBatch", now.arrowMaxBytesPerBatch(), BATCH_BYTES)):
        if not 0 < held <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see. Where the session names none, a local session gets a temporary
    one; a cluster's executors could not read that, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/harrow-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df to the shared folder and go on from the files: lost executors lose no work, and
    what reads the result starts from a scan."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._harrow_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove a table made by cut() that nothing will read again."""
    path = getattr(df, "_harrow_path", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def most_frequent(counted: DataFrame, column: Column | str, most: int) -> tuple[Column, int]:
    """(rank, least): rows with rank >= least are the most frequent ones, at most `most` of them. Ranks
    are sixteenths of a doubling of the count, so that the driver sees a row a rank, a thousand at most."""
    rank = F.floor(F.log2(column) * 16)
    held, least = 0, 1 << 30
    for r in counted.groupBy(rank.alias("rank")).agg(F.count("*").alias("n")).orderBy(F.desc("rank")).collect():
        held += r["n"]
        if held > most:
            break
        least = r["rank"]
    return rank, least


# ---------------------------------------------------------------- words of an Arrow batch

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
#: Bytes hashed at once; the power tables of this length stay in the CPU's cache.
PIECE = 1 << 16
CHUNK_BYTES = 2 << 20
_K = np.uint64(0x9E3779B97F4A7C15)
_KINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(k: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, k, np.uint64)]))


_POW, _POWINV = _powers(_K, PIECE), _powers(_KINV, PIECE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts one after another, and where each begins; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `most` bytes; a longer document is a run of its own."""
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, last
        first = last


def word_hashes(raw: np.ndarray, at: np.ndarray, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the documents raw[at[i]:at[i+1]], and where each document's
    words begin among them. Works through pieces, so that a long text takes 3 bytes a byte."""
    space = SPACE[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = at[(at > 0) & (at < len(raw))]
    begins[inner] = ~space[inner]
    starts = np.flatnonzero(begins)
    del begins
    out = np.empty(len(starts), np.uint64)
    i = 0
    ends = np.append(starts[1:], len(raw))
    while i < len(starts):
        a = starts[i]
        j = int(np.searchsorted(ends, a + PIECE, "right"))
        if j > i:
            b = ends[j - 1]
            value = fold[raw[a:b]].astype(np.uint64)
            value += np.uint64(1)
            value[space[a:b]] = 0
            value *= _POW[: b - a]
            off = starts[i:j] - a
            out[i:j] = np.add.reduceat(value, off) * _POWINV[off]
            i = j
        else:  # one word, or the white space after it, is longer than a piece
            b, total, scale = ends[i], np.uint64(0), np.uint64(1)
            with np.errstate(over="ignore"):
                for p in range(a, b, PIECE):
                    q = min(b, p + PIECE)
                    value = (fold[raw[p:q]].astype(np.uint64) + np.uint64(1)) * ~space[p:q]
                    total += np.add.reduce(value * _POW[: q - p]) * scale
                    scale *= _POW[-1] * _K
            out[i] = total
            i += 1
    return mix(out), np.searchsorted(starts, at)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last index of each run of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return first, np.append(first[1:], len(keys))


def key_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of a stream that is sorted by key, several small groups to a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(column, column[-1], "left"))
        if held and last == 0 and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() == column[-1]:
            held.append(batch)
            continue
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)], batch.schema)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        return np.fromiter((self.root(i) for i in range(len(self.up))), np.int64, len(self.up))


def hook(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs (a, b) in a union-find whose every pointer is at its root, the smallest member."""
    while len(a):
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        up = up.copy()
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    return up


# ---------------------------------------------------------------- connected components


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Nodes of the edges (long columns a, b) with the smallest node that each reaches: node, component.

    Large-star and small-star rounds: each links nodes to the smallest neighbour that they know of.
    A round's edges are written to the shared folder; sides of a join are plain scans, so that
    Spark can split a node with very many edges. Null ends and loops are left out; no edges, no rows."""
    e = cut(
        edges.where((F.col(a) != F.col(b))).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(),
        "edges",
    )
    held = None
    for _ in range(rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        # a node's larger neighbours, and itself, go to the smallest node around it
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        least2 = cut(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least2, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").unionAll(least2.select("hi", F.col("m").alias("lo")))
        new = cut(small.distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        for old in (e, least, large, least2):
            drop_cut(old)
        e = new
        if state == held:
            break
        held = state
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "node")
    return stars.unionAll(e.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node")))
