"""N-gram Jaccard join: texts that share 80 % of their five-word shingles, and their components.

1. Each text becomes a set of shingle hashes; equal sets are one class from there on.
2. Two sets that link share a shingle among their first n - ceil(0.8 n) + 1 in any common order
   (prefix filter). Classes that share one meet in a group; the order puts very frequent shingles
   last, so that common passages make no groups unless a text consists of them. Many shingles have
   the same members: such groups are one.
3. In a group, classes are the leaves of signature trees: nodes hold the OR of their token bitmaps
   and the range of sizes. A dual traversal drops node pairs whose largest possible overlap is too
   small; what is left are plausible links, of which a spanning forest leaves the task.
4. Plausible links make clusters (connected components). A cluster's whole sets meet once, and a
   second dual traversal with exact overlaps finds the links that make the components. Clusters of
   more than CELL_TOKENS shingles are dealt as a grid of blocks.
No step loses a link between different texts, and no step emits the pairs of a group.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own
component; fewer than five words are one shingle; a null doc_id takes no part (null component);
rows with one doc_id and different sets are nodes of their own, each with the smallest doc_id that its
own links reach; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

WORDS = 5
#: A frequent shingle: in so many different sets among about COUNT_TOKENS shingles of a partition.
COUNT_TOKENS, FREQUENT = 1_000_000, 16
#: So many frequent shingles, the most frequent ones, are put last in the order; the choice changes the work, not the links.
LAST = 65_536
#: Classes of a group, and shingles of a cluster, that meet in one block of a grid.
GROUP_BLOCK, CELL_TOKENS = 20_000, 3_000_000
LEAF, FAN = 32, 8
_C = core.mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def links(inter, a, b):
    """100 * intersection >= 80 * union."""
    return 9 * inter >= 4 * (a + b)


def sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a batch."""
    raw, at = core.text_bytes(column)
    for first, last in core.chunks(at):
        words, begin = core.word_hashes(raw[at[first] : at[last]], at[first : last + 1] - at[first], core.LOWER)
        n = len(words) - WORDS + 1
        if n > 0:
            shingles = words[:n] * _C[0]
            for k in range(1, WORDS):
                shingles += words[k : k + n] * _C[k]
            shingles = core.mix(shingles)
        for i in range(last - first):
            s, e = begin[i], begin[i + 1]
            if e - s >= WORDS:
                yield np.unique(shingles[s : e - WORDS + 1])
            elif e > s:
                yield core.mix(np.array([(words[s:e] * _C[: e - s]).sum() + np.uint64(e - s)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """64 bits for a whole set; together with its size they name a class."""
    return int(core.mix(np.array([core.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray) -> np.ndarray:
    """Two to four bits a shingle, a power of two, so that larger bitmaps fold onto smaller ones."""
    width = max(64, 1 << int(2 * len(s) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (doc_id, cid, n, bits, text_key) and of frequent shingles (token, hits)."""
    seen: set = set()
    held: list[np.ndarray] = []
    size = 0

    def frequent() -> pa.RecordBatch:
        token, hits = np.unique(np.concatenate(held), return_counts=True)
        token, hits = token[hits >= FREQUENT], hits[hits >= FREQUENT]
        none = pa.nulls(len(token), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(token), pa.binary()), pa.array(token.view(np.int64)), pa.array(hits), none], names)

    names = ["doc_id", "cid", "n", "bits", "token", "hits", "text_key"]
    for b in batches:
        cids, ns, bits = [], [], []
        for s, named in zip(sets(b.column(1)), b.column(0).is_valid().to_pylist(), strict=True):
            cid = set_id(s)
            # rows without doc_id are left out later, so none of them may stand for its class
            new = named and (cid, len(s)) not in seen
            if new and len(s):
                seen.add((cid, len(s)))
                held.append(s)
                size += len(s)
            cids.append(cid)
            ns.append(len(s))
            bits.append(bitmap(s).tobytes() if new and len(s) else None)
        none = pa.nulls(b.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cids, pa.int64()), pa.array(ns, pa.int64()), pa.array(bits, pa.binary()), none, none, b.column(2)], names)
        if size >= COUNT_TOKENS:
            yield frequent()
            held, size = [], 0
    if held:
        yield frequent()


def _prefixes(last: np.ndarray, blocks: np.ndarray):
    """(cell, cid, n): a cell is a shingle, or one block pair of a very frequent one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            cells, cids, ns = [], [], []
            for s in sets(b.column(1)):
                n = len(s)
                cid = set_id(s) if n else 0
                if not n or (cid, n) in seen:
                    continue
                seen.add((cid, n))
                p = n - -(-80 * n // 100) + 1
                if len(last):
                    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                    hot = last[at] == s
                    cold = s[~hot]
                    if len(cold) >= p:
                        s = cold[:p]
                    else:
                        more = s[hot][: p - len(cold)]
                        many = blocks[at[hot][: p - len(cold)]]
                        for token, k in zip(more[many > 1], many[many > 1], strict=True):
                            home = cid % int(k)
                            for away in range(int(k)):
                                pair = np.uint64(min(home, away) * int(k) + max(home, away) + 1)
                                cells.append(core.mix(np.array([token + pair * _C[0]], np.uint64)))
                                cids.append(cid)
                                ns.append(n)
                        s = np.concatenate([cold, more[many == 1]])
                else:
                    s = s[:p]
                cells.append(s)
                cids += [cid] * len(s)
                ns += [n] * len(s)
            if cells:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view(np.int64)), pa.array(cids, pa.int64()), pa.array(ns, pa.int64())], ["cell", "cid", "n"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], block: int = GROUP_BLOCK) -> Iterator[pa.RecordBatch]:
    """(grp, cid, n) of the classes that share a cell and have a partner of a size near their own;
    groups with the same members have the same grp, and leave a task once. A group of more than `block`
    classes, however it came to be so large, leaves as a grid: one group a pair of its blocks."""
    seen: set = set()
    for t in core.key_groups(batches, "cell"):
        cell, cid, n = (t.column(c).to_numpy() for c in ("cell", "cid", "n"))
        order = np.lexsort((cid, n, cell))
        cell, cid, n = cell[order], cid[order], n[order]
        new = np.append(True, (cell[1:] != cell[:-1]) | (cid[1:] != cid[:-1]) | (n[1:] != n[:-1]))
        cell, cid, n = cell[new], cid[new], n[new]
        # a group ends with its cell, or where the next larger set is too large for all before
        first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (5 * n[:-1] < 4 * n[1:])))
        size = np.diff(np.append(first, len(cell)))
        name = core.mix(np.add.reduceat(core.mix(cid.view(np.uint64) + n.astype(np.uint64)), first) + size.astype(np.uint64))
        keep = np.zeros(len(first), bool)
        for i in np.flatnonzero(size > 1):
            key = int(name[i])
            if key not in seen:
                seen.add(key)
                keep[i] = True
        for i in np.flatnonzero(keep & (size > block)):
            keep[i] = False
            a, b = first[i], first[i] + size[i]
            k = -(-int(size[i]) // block)
            home = (core.mix(cid[a:b].view(np.uint64)) % np.uint64(k)).astype(np.int64)
            for away in range(k):
                pair = np.minimum(home, away) * k + np.maximum(home, away) + 1
                grp = core.mix(name[i] + pair.astype(np.uint64) * _C[0])
                yield pa.RecordBatch.from_arrays([pa.array(grp.view(np.int64)), pa.array(cid[a:b]), pa.array(n[a:b])], ["grp", "cid", "n"])
        take = np.repeat(keep, size)
        if take.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[take].view(np.int64)), pa.array(cid[take]), pa.array(n[take])], ["grp", "cid", "n"])


class Tree:
    """A signature tree over sets in order of size: level 0 are blocks of LEAF sets, each higher
    node joins FAN nodes. A node knows the OR of its bitmaps, its sizes' range and the least bits."""

    def __init__(self, bits: np.ndarray, n: np.ndarray):
        self.bits, self.n = bits, n
        count = np.bitwise_count(bits).sum(1, dtype=np.int64)
        at = np.arange(0, len(n), LEAF)
        self.levels = [(np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(n, at), np.maximum.reduceat(n, at), np.minimum.reduceat(count, at))]
        while len(self.levels[-1][1]) > 1:
            o, lo, hi, c = self.levels[-1]
            at = np.arange(0, len(lo), FAN)
            self.levels.append((np.bitwise_or.reduceat(o, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.minimum.reduceat(c, at)))

    def may(self, level: int, i: np.ndarray, other: Tree, j: np.ndarray) -> np.ndarray:
        """Whether a set under node i and one under node j of the other tree can link at all."""
        o, lo, hi, c = (x[i] for x in self.levels[level])
        p, lo2, hi2, c2 = (x[j] for x in other.levels[level])
        common = np.bitwise_count(o & p).sum(1, dtype=np.int64)
        # every set has at least c bits, at most `common` of them under the other node; the rest of its shingles find no partner
        most = np.minimum(hi - np.maximum(0, c - common), hi2 - np.maximum(0, c2 - common))
        return (5 * hi >= 4 * lo2) & (5 * hi2 >= 4 * lo) & links(most, lo, lo2)


def dual(a: Tree, b: Tree, same: bool, found: Callable[[int, int, np.ndarray, np.ndarray], None]) -> None:
    """Traverse two trees together; found(i0, j0, rows, columns) gets plausible pairs of leaf blocks."""
    top = max(len(a.levels), len(b.levels)) - 1
    for t in (a, b):
        while len(t.levels) <= top:
            t.levels.append(t.levels[-1])
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(top, -1, -1):
        ok = a.may(level, i, b, j)
        i, j = i[ok], j[ok]
        if not len(i):
            return
        if level:
            down = np.arange(FAN)
            wide_a = len(a.levels[level - 1][1]) > len(a.levels[level][1])
            wide_b = len(b.levels[level - 1][1]) > len(b.levels[level][1])
            ia = (i[:, None] * FAN + down if wide_a else i[:, None])
            jb = (j[:, None] * FAN + down if wide_b else j[:, None])
            x = np.repeat(ia, jb.shape[1], axis=1).ravel()
            y = np.tile(jb, (1, ia.shape[1])).ravel()
            inside = (x < len(a.levels[level - 1][1])) & (y < len(b.levels[level - 1][1]))
            if same:
                inside &= x <= y
            i, j = x[inside], y[inside]
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        found(p * LEAF, q * LEAF, np.arange(p * LEAF, min(len(a.n), (p + 1) * LEAF)), np.arange(q * LEAF, min(len(b.n), (q + 1) * LEAF)))


def plausible(bits: list[np.ndarray], n: np.ndarray, link: Callable[[int, int], bool], side: np.ndarray | None = None) -> core.Forest:
    """Dual traversal over sets with bitmaps of several widths; link(i, j) decides on a pair whose
    bitmaps allow it, unless i and j are joined already. side: only pairs of different sides count."""
    forest = core.Forest(len(n))
    widths = np.array([len(x) for x in bits])
    tiers = np.unique(widths)
    order = {w: (at := np.flatnonzero(widths == w))[np.argsort(n[at], kind="stable")] for w in tiers}

    def meet(rows: np.ndarray, cols: np.ndarray, w: int, same: bool) -> None:
        if not len(rows) or not len(cols):
            return
        a = Tree(np.stack([bits[k] for k in rows]), n[rows])
        b = a if same else Tree(np.stack([np.bitwise_or.reduce(bits[k].reshape(-1, w), axis=0) for k in cols]), n[cols])

        def leaf(i0: int, j0: int, p: np.ndarray, q: np.ndarray) -> None:
            ri = np.fromiter((forest.root(x) for x in rows[p].tolist()), np.int64, len(p))
            rj = np.fromiter((forest.root(x) for x in cols[q].tolist()), np.int64, len(q))
            open_ = ri[:, None] != rj[None, :]
            if side is not None:
                open_ &= side[rows[p]][:, None] != side[cols[q]][None, :]
            if same and i0 == j0:
                open_ &= p[:, None] < q[None, :]
            if not open_.any():
                return
            x, y = a.bits[p], b.bits[q]
            both = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(2, dtype=np.int64)
            ca, cb = np.bitwise_count(x).sum(1, dtype=np.int64), np.bitwise_count(y).sum(1, dtype=np.int64)
            na, nb = a.n[p][:, None], b.n[q][None, :]
            most = np.minimum(na - (ca[:, None] - both), nb - (cb[None, :] - both))
            i, j = np.nonzero(open_ & links(most, na, nb))
            for u, v in zip(rows[p[i]].tolist(), cols[q[j]].tolist(), strict=True):
                if forest.root(u) != forest.root(v) and link(u, v):
                    forest.join(u, v)

        dual(a, b, same, leaf)

    for k, w in enumerate(tiers):
        rows = order[w]
        meet(rows, rows, w, True)
        if k + 1 < len(tiers) and tiers[k + 1] == 2 * w:
            cols = order[tiers[k + 1]]
            meet(rows, cols[4 * n[cols] <= 5 * n[rows].max()], w, False)
    return forest


def _edges(ids: np.ndarray, forest: core.Forest) -> tuple[np.ndarray, np.ndarray]:
    roots = forest.roots()
    at = np.flatnonzero(roots != np.arange(len(roots)))
    return ids[at], ids[roots[at]]


def _plausible_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group (grp, node, n, bits): a spanning forest of the links that the bitmaps allow."""
    for t in core.key_groups(batches, "grp"):
        grp, rep, n = (t.column(c).to_numpy() for c in ("grp", "node", "n"))
        raw = t.column("bits").to_pylist()
        out = []
        for a, b in zip(*core.runs(grp), strict=True):
            if b - a > 1:
                bits = [np.frombuffer(x, np.uint64) for x in raw[a:b]]
                out.append(_edges(rep[a:b], plausible(bits, n[a:b].astype(np.int64), lambda i, j: True)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], ["a", "b"])


def _true_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per cell (cell, side, split, node, cid, text): a spanning forest of the links."""
    for t in core.key_groups(batches, "cell"):
        cell, rep, cid, side, split = (t.column(c).to_numpy() for c in ("cell", "node", "cid", "side", "split"))
        found = list(sets(t.column("text").combine_chunks()))
        out = []
        for a, b in zip(*core.runs(cell), strict=True):
            # a doc_id that is repeated may bring other texts
            at = [i for i in range(a, b) if len(found[i]) and set_id(found[i]) == cid[i]]
            if len(at) > 1:
                own = [found[i] for i in at]

                def link(i: int, j: int, own: list = own) -> bool:
                    x, y = (own[i], own[j]) if len(own[i]) <= len(own[j]) else (own[j], own[i])
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    return bool(links(int((y[at] == x).sum()), len(x), len(y)))

                sides = side[at] if split[a] else None
                out.append(_edges(rep[at], plausible([bitmap(s) for s in own], np.array([len(s) for s in own]), link, sides)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in (0, 1)], ["a", "b"])


def _keeping(cut: DataFrame, df: DataFrame) -> DataFrame:
    """df, which reads the table of cut and nothing else, with that table's place."""
    df._harrow_path = cut._harrow_path
    return df


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), set_id (of the set of
    shingles) and text_key (xxhash64 of the text) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    core.small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = docs.withColumn("text_key", F.xxhash64("text")).mapInArrow(_measure, "doc_id long, cid long, n long, bits binary, token long, hits long, text_key long")
    measured = core.cut(measured, "sets")
    ids = core.cut(measured.where("n is not null").select("doc_id", "cid", "n", "text_key"), "ids")
    hits = core.cut(measured.where("token is not null").groupBy("token").agg(F.sum("hits").alias("hits")), "hits")
    rank, least = core.most_frequent(hits, "hits", LAST)
    hot = hits.where(rank >= least).collect()
    core.drop_cut(hits)
    last = np.array([r.token for r in hot], np.int64).view(np.uint64)
    by = np.argsort(last)
    last, blocks = last[by], np.array([-(-r.hits // GROUP_BLOCK) for r in hot], np.int64)[by]
    cast = spark.sparkContext.broadcast((last, blocks))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _prefixes(*cast.value)(batches)

    named = docs.where("doc_id is not null")
    cells = named.mapInArrow(prefixes, "cell long, cid long, n long").repartition("cell").sortWithinPartitions("cell")
    groups = core.cut(cells.mapInArrow(_groups, "grp long, cid long, n long"), "groups")
    classes = measured.where("n > 0 and doc_id is not null").groupBy("cid", "n").agg(F.min("doc_id").alias("rep"), F.max("bits").alias("bits"))
    classes = core.cut(classes, "classes")
    core.drop_cut(measured)
    # a class is named by its smallest doc_id; where several have the same, by a hash but one
    shared = core.cut(classes.groupBy("rep").agg(F.count("*").alias("k"), F.min(F.struct("n", "cid")).alias("f")).where("k > 1").select("rep", "f"), "shared")
    apart = bool(shared.head(1))
    if apart:
        own = F.col("f").isNull() | (F.col("f") == F.struct("n", "cid"))
        old, classes = classes, core.cut(classes.join(shared, "rep", "left").withColumn("node", F.when(own, F.col("rep")).otherwise(F.xxhash64("rep", "cid", "n"))).drop("f"), "classes")
        core.drop_cut(old)
    else:
        classes = _keeping(classes, classes.withColumn("node", F.col("rep")))
    core.drop_cut(shared)
    met = groups.distinct().join(classes, ["cid", "n"]).select("grp", "node", "n", "bits")
    loose = core.cut(met.repartition("grp").sortWithinPartitions("grp").mapInArrow(_plausible_links, "a long, b long"), "loose")
    core.drop_cut(groups)
    clusters = core.connected_components(loose)
    core.drop_cut(loose)
    members = core.cut(classes.select("node", "rep", "cid", "n").join(clusters, "node").withColumnRenamed("component", "cluster"), "members")
    sums = core.cut(members.groupBy("cluster").agg(F.ceil(F.sum("n") / CELL_TOKENS).cast("int").alias("blocks")), "blocks")
    placed = members.join(sums, "cluster").withColumn("home", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("away", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("node", "rep", "cid", F.xxhash64("cluster", F.least("home", "away"), F.greatest("home", "away")).alias("cell"), (F.col("home") > F.col("away")).cast("int").alias("side"), (F.col("home") != F.col("away")).alias("split"))
    whole = placed.join(named.withColumnRenamed("doc_id", "rep"), "rep").repartition("cell").sortWithinPartitions("cell")
    true = core.cut(whole.select("cell", "side", "split", "node", "cid", "text").mapInArrow(_true_links, "a long, b long"), "links")
    core.drop_cut(members)
    core.drop_cut(sums)
    comps = core.connected_components(true)
    core.drop_cut(true)
    if apart:
        least = comps.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
        comps = comps.join(least, "component").select("node", F.col("least").alias("component"))
    known = core.cut(classes.select("cid", "n", "rep", "node").join(comps, "node", "left").select("cid", "n", F.coalesce("component", "rep").alias("component")), "known")
    core.drop_cut(classes)
    linked = ids.where("n > 0 and doc_id is not null").join(known, ["cid", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("cid").alias("set_id"), "text_key")
    return linked.unionByName(ids.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("cid").alias("set_id"), "text_key"))
