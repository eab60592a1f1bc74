"""Near-duplicate vectors: random-hyperplane signatures in several tables, exact cosines, components.

Equal vectors of a label collapse to a class first. Each table cuts the classes' signatures into
buckets; only buckets of two classes or more get vectors. A bucket of more than BLOCK classes becomes
a grid of blocks, so no task holds more than two blocks, and a block pair is one matrix product. A
pair is counted in the first table where it meets. Tasks return a row per class: the weight of its
partners and the root of its links, never the pairs.

The signature's length follows the data: the logarithm of the classes of the largest label, and MORE_BITS
above it, so that a bucket holds few unrelated vectors at any size. The number of tables follows from
it: vectors at cosine 0.98 agree on a bit with probability 0.936, and there are as many tables as keep
the probability that a pair at the very threshold is missed at MISS or less; closer pairs are missed less.
(2^13 classes take 16 bits and 20 tables, 2^30 take 33 and 71.)

Defined results: vectors are scaled by powers of two first, so that very large or small components
neither overflow nor vanish; null or empty vectors, zero vectors, null, NaN or infinite components and a null
label link with nothing (n_links 0, a component of their own); vectors of different length never
link; repeated rows count as vectors of their own; a null vec_id takes no part: no links, null
component, kept false; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

COSINE, BLOCK, SEED = 0.98, 256, 7
MISS, MORE_BITS, LEAST_BITS = 2e-4, 3, 8
#: Vectors in one matrix product's rows; bounds what a task computes at once.
ROWS = 512


def design(classes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits) for so many different vectors of one label."""
    bits = max(LEAST_BITS, min(60, math.ceil(math.log2(max(classes, 1))) + MORE_BITS))
    agree = 1 - math.acos(cosine) / math.pi
    return math.ceil(math.log(miss) / math.log1p(-(agree**bits))), bits


def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def _signatures(tables: int, bits: int):
    weights = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("vec"))
            vectors = [np.frombuffer(x.as_buffer(), np.float64) for x in column]
            out = np.zeros((b.num_rows, tables), np.int64)
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                signs = np.stack([vectors[i] for i in at]) @ _planes(int(dim), tables, bits) > 0
                out[at] = signs.reshape(len(at), tables, bits) @ weights
            sigs = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, sigs], [*b.schema.names, "sigs"])

    return run


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, mult, label, embedding -> the same with vec, the components as bytes of doubles."""
    for b in batches:
        column = b.column(b.schema.get_field_index("embedding"))
        offsets = np.asarray(column.offsets).astype(np.int64)
        flat = np.asarray(column.values.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
        whole = (flat[offsets[i] : offsets[i + 1]] for i in range(b.num_rows))
        # by a power of two, which changes no cosine, the largest component comes into 0.5..1
        vec = pa.array([np.ldexp(v, -np.frexp(np.abs(v).max())[1]).tobytes() for v in whole], pa.binary())
        keep = [b.column(b.schema.get_field_index(c)) for c in ("rep", "mult", "label")]
        yield pa.RecordBatch.from_arrays([*keep, vec], ["rep", "mult", "label", "vec"])


def _compare(cosine: float, tables: int):
    def cell(t: pa.Table):
        """rep, links, root of the classes in one cell that link there."""
        get = lambda c: t.column(c).to_numpy()
        rep, mult, side, label, table = (get(c) for c in ("rep", "mult", "side", "label", "tab"))
        rep, mult = rep.astype(np.int64), mult.astype(np.int64)
        order = np.lexsort((rep, side))
        raw = t.column("vec").to_pylist()
        sizes = np.array([len(raw[i]) for i in order])
        if (sizes != sizes[0]).any() or (label != label[0]).any() or (table != table[0]).any():  # two buckets with one hash
            parts = {}
            for i in range(len(rep)):
                parts.setdefault((len(raw[i]), label[i], table[i]), []).append(i)
            for at in parts.values():
                if len(at) > 1:
                    yield from cell(t.take(pa.array(at)))
            return
        v = np.frombuffer(b"".join(raw[i] for i in order), np.float64).reshape(len(order), -1)
        sigs = np.asarray(t.column("sigs").combine_chunks().flatten()).reshape(len(rep), tables)[order]
        rep, mult, side, tab = rep[order], mult[order], side[order], int(table[0])
        # small numbers for the signatures of this cell, a row a table
        codes = np.stack([np.unique(sigs[:, k], return_inverse=True)[1].astype(np.uint32) for k in range(tab + 1)])
        norms, weight = np.sqrt((v * v).sum(1)), mult.astype(np.float64)
        cut = int(np.searchsorted(side, 1)) if side.any() else 0
        left, right = (np.arange(cut), np.arange(cut, len(rep))) if cut else (np.arange(len(rep)),) * 2
        links = np.zeros(len(rep))
        up = np.arange(len(rep))
        for s in range(0, len(left), ROWS):
            rows = left[s : s + ROWS]
            hit = (v[rows] @ v[right].T) / np.outer(norms[rows], norms[right]) >= cosine
            if not cut:
                hit &= rows[:, None] < right[None, :]
            hit &= codes[tab][rows][:, None] == codes[tab][right][None, :]
            for k in range(tab):  # counted there already
                if not hit.any():
                    break
                hit &= codes[k][rows][:, None] != codes[k][right][None, :]
            links[rows] += hit @ weight[right]
            links[right] += weight[rows] @ hit
            some = np.flatnonzero(hit.any(1))
            up = core.hook(up, rows[some], right[hit[some].argmax(1)])
            a, b = np.nonzero(hit)
            a, b = rows[a], right[b]
            apart = up[a] != up[b]
            up = core.hook(up, a[apart], b[apart])
        links = links.astype(np.int64)
        at = np.flatnonzero(links)
        if len(at):
            low = {}
            for i in at:
                low[up[i]] = min(low.get(up[i], rep[i]), rep[i])
            yield rep[at], links[at], np.array([low[up[i]] for i in at], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in core.key_groups(batches, "cell"):
            keys = t.column("cell").to_numpy()
            found = [x for a, b in zip(*core.runs(keys), strict=True) if b - a > 1 for x in cell(t.slice(a, b - a))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], ["rep", "links", "root"])

    return run


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings (vec_id, embedding, label)."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)
    e = e.withColumn("able", F.coalesce(able, F.lit(False)))
    hashed = e.withColumns({"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64("embedding", F.reverse("embedding"), "label")})
    # 128 bits of hash stand for a label and vector
    firsts = hashed.where("able").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = core.cut(firsts, "classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    tables, bits = design(largest or 0, cosine, miss)
    vectors = classes.select("rep", "mult", "label", "embedding").mapInArrow(_doubles, "rep long, mult long, label string, vec binary")
    signed = core.cut(vectors.mapInArrow(_signatures(tables, bits), "rep long, mult long, label string, vec binary, sigs array<long>"), "signed")
    bucket = F.xxhash64("label", F.octet_length("vec"), "tab", "sig")
    narrow = signed.select("rep", "label", "vec", F.posexplode("sigs").alias("tab", "sig")).select("rep", "tab", bucket.alias("bucket"))
    counts = core.cut(narrow.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = narrow.join(counts, "bucket").withColumn("blocks", blocks).withColumn("home", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("away", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("rep", "tab", F.xxhash64("bucket", F.least("home", "away"), F.greatest("home", "away")).alias("cell"), (F.col("home") > F.col("away")).cast("int").alias("side"))
    # within one block both sides are the same rows; across blocks the lower block is side 0
    cells = met.join(signed, "rep").repartition("cell").sortWithinPartitions("cell")
    found = core.cut(cells.select("cell", "rep", "mult", "label", "tab", "side", "vec", "sigs").mapInArrow(_compare(cosine, tables), "rep long, links long, root long"), "found")
    core.drop_cut(signed)
    core.drop_cut(counts)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = core.connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.select("k1", "k2", "rep", "mult").join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    known = core.cut(known.select("k1", "k2", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "known")
    core.drop_cut(classes)
    core.drop_cut(found)
    out = hashed.select("vec_id", "able", F.when(F.col("able"), F.col("k1")).alias("k1"), F.when(F.col("able"), F.col("k2")).alias("k2"))
    linked = out.where("able").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = out.where("not able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
