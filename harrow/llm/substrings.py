"""Substring deduplication: words inside a run of 50 that an earlier document has too are removed.

Recompression names what repeats. Level by level, a text's symbols (words at first) are rounded: runs
of one symbol become one, then pairs do whose first symbol is "left" and second "right" by a bit of
their names. Names are hashes of what they join, so they are global without a dictionary, and equal
substrings get equal symbols but near their ends. For each symbol we keep the words on which it
depends; every 50-word window picks the leftmost symbol of the highest level that depends on the
window alone. Equal windows pick equal symbols, so a window whose symbol occurs in one document only
cannot repeat. Shuffle 1 finds the symbols that documents share; shuffle 2 verifies the windows that
picked them, by 95 bits of hash of the window's own words, and finds the smallest document of each.
Both are pre-aggregated: what repeats within a task's chunk is settled there, a symbol or window sends
one row a chunk with all its places, and one that several documents of a task have sends one a task.
Documents that repeat a smaller one whole are found first, by 128 bits of hash, and take no part.

Two things differ from recompression as published: names are hashes instead of numbers from a global
dictionary, which needs no exchange a level; and runs are named in the first round only, since in
later ones that would make symbols depend on more words than windows have.

Defined results: null, empty and blank texts have no words; texts under 50 words lose nothing; a null
doc_id keeps its text and takes nothing from others; rows that repeat a doc_id with the same text get
the same result, rows with other texts are judged each by their own words, and none against another
row of its doc_id; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

WINDOW = 50
#: Rounds of pair naming; a round with True names runs first. Later rounds depend on more words than a window has.
ROUNDS = (True, False, False, False, False, False, False, False)
FAR = 1 << 40
ROW = ["key", "doc", "tag", "own"]
_A, _B, _C = (core.mix(np.array([x], np.uint64)) | np.uint64(1) for x in (11, 22, 33))
_K1, _K2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


class Level:
    """The symbols of a chunk: names, the words [lo, hi) that each depends on, and its document."""

    def __init__(self, name, lo, hi, doc):
        self.name, self.lo, self.hi, self.doc = name, lo, hi, doc

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """lo of the symbol before and hi of the one after, far away at the ends of a document."""
        before = np.full(len(self.lo), -FAR)
        after = np.full(len(self.hi), FAR)
        same = self.doc[1:] == self.doc[:-1]
        before[1:] = np.where(same, self.lo[:-1], -FAR)
        after[:-1] = np.where(same, self.hi[1:], FAR)
        return before, after

    def runs(self) -> Level:
        """Runs of one symbol become one; that a run ends depends on its neighbours."""
        if len(self.name) < 2:
            return self
        new = np.append(True, (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1]))
        before, after = self.edges()
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(new)) - 1
        length = last - first + 1
        name = self.name[first]
        name = np.where(length > 1, core.mix(name * _C + length.astype(np.uint64)), name)
        return Level(name, before[first], after[last], self.doc[first])

    def pairs(self, seed: int) -> Level:
        """Left-right neighbours become one symbol; a left or right symbol that stays depends on the neighbour that it could have joined."""
        if len(self.name) < 2:
            return self
        right = core.mix(self.name ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(63) == 1
        joins = np.append(~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1]), False)
        second = np.append(False, joins[:-1])
        before, after = self.edges()
        lo = np.where(right, before, self.lo)
        hi = np.where(right, self.hi, after)
        at = np.flatnonzero(joins)
        name = self.name.copy()
        name[at] = core.mix(self.name[at] * _A + self.name[at + 1] * _B + np.uint64(seed))
        lo[at], hi[at] = self.lo[at], self.hi[at + 1]
        keep = ~second
        return Level(name[keep], lo[keep], hi[keep], self.doc[keep])


def picks(words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, document, first, last): the symbols that windows pick, with the windows' starts, counted within the document."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    at = np.arange(len(words))
    levels = [Level(words, at, at + 1, doc)]
    for r, named in enumerate(ROUNDS):
        top = levels[-1]
        levels.append((top.runs() if named else top).pairs(r + 1))
    end = begin[1:][doc]
    open_ = at + WINDOW <= end
    out = []
    for k in range(len(levels) - 1, -1, -1):
        count = np.append(0, np.cumsum(open_))
        if not count[-1]:
            break
        v = levels[k]
        before = v.edges()[0]
        # this symbol is the leftmost inside for starts after the lo of the one before
        a = np.maximum(np.maximum(before + 1, v.hi - WINDOW), begin[v.doc])
        b = np.minimum(v.lo, begin[v.doc + 1] - WINDOW)
        ok = np.flatnonzero(a <= b)
        a, b = a[ok], b[ok]
        need = count[b + 1] > count[a]
        a, b, ok = a[need], b[need], ok[need]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, a, 1)
        np.add.at(edge, b + 1, -1)
        open_ &= np.cumsum(edge[:-1]) == 0
        d = v.doc[ok]
        out.append((core.mix(v.name[ok] + np.uint64(k) * _C), d, a - begin[d], b - begin[d]))
    if not out:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([x[i] for x in out]) for i in range(4))


def _packed(doc: np.ndarray, value: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """One row a document: its values as bytes of 64-bit numbers."""
    order = np.argsort(doc, kind="stable")
    doc, value = doc[order], value[order]
    first, last = core.runs(doc)
    return pa.array(doc[first]), pa.array([value[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())


def _settled(own: tuple[pa.Array, pa.Array]) -> Iterator[pa.RecordBatch]:
    """Places that need no one else go with the other rows to the task that a hash of their document names."""
    if len(own[0]):
        spread = core.mix(own[0].to_numpy().view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(spread), own[0], pa.nulls(len(spread), pa.int64()), own[1]], ROW)


def _open(key: np.ndarray, doc: np.ndarray, tag: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each run [first, last) of one key and document: the first tag, and all tags where there are several."""
    if len(first):
        one = last - first == 1
        own = pa.array([None if o else tag[a:b].tobytes() for o, a, b in zip(one.tolist(), first.tolist(), last.tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(doc[first]), pa.array(tag[first]), own], ROW)


class Known:
    """Keys that several documents of this task have, with the smallest document that was sent: at most MOST of them."""

    MOST = 1 << 20

    def __init__(self):
        self.key, self.check, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The document sent for each key, or one above all."""
        out = np.full(len(key), np.iinfo(np.int64).max)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            same = (self.key[at] == key) & (self.check[at] == check)
            out[same] = self.doc[at[same]]
        return out

    def add(self, key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> None:
        if len(key) and len(self.key) < self.MOST:
            key, check, doc = (np.concatenate(x) for x in ((self.key, key), (self.check, check), (self.doc, doc)))
            order = np.lexsort((doc, check, key))
            key, check, doc = key[order], check[order], doc[order]
            new = np.append(True, key[1:] != key[:-1])
            self.key, self.check, self.doc = key[new], check[new], doc[new]


def _shared_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Known()
    for batch in batches:
        raw, at = core.text_bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        for first, last in core.chunks(at):
            words, begin = core.word_hashes(raw[at[first] : at[last]], at[first : last + 1] - at[first])
            name, d, a, b = picks(words, begin)
            doc, tag = ids[first:last][d], a << 32 | b
            order = np.lexsort((doc, name))
            name, doc, tag = name[order], doc[order], tag[order]
            s, e = core.runs(name)
            if not len(s):
                continue
            zero = np.zeros(len(s), np.int64)
            sent = known.least(name[s], zero) < np.iinfo(np.int64).max
            several = doc[s] != doc[e - 1]
            # a symbol of several documents of this task is shared: one row goes on, for others to see
            yield from _open(name, doc, tag, s[~several & ~sent], e[~several & ~sent])
            lead = s[several & ~sent]
            yield from _open(name, doc, tag, lead, lead + 1)
            here = np.repeat(several | sent, e - s)
            yield from _settled(_packed(doc[here], tag[here]))
            known.add(name[lead], zero[: len(lead)], doc[lead])


def _singles(doc: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """A row for each value."""
    at = pa.array(np.arange(0, 8 * len(value) + 1, 8, dtype=np.int32)).buffers()[1]
    own = pa.Array.from_buffers(pa.binary(), len(value), [None, at, pa.py_buffer(np.ascontiguousarray(value))])
    return pa.RecordBatch.from_arrays([pa.array(doc), own], ["doc", "own"])


def _held(batches: Iterator[pa.RecordBatch], choose) -> Iterator[pa.RecordBatch]:
    """(doc, own) of the settled rows, and of those that choose(key, doc, tag) marks in whole groups of key."""
    for t in core.key_groups(batches, "key"):
        done = t.filter(t.column("tag").is_null())
        if done.num_rows:
            yield from done.select(["doc", "own"]).to_batches()
        t = t.filter(t.column("tag").is_valid())
        key, doc, tag = (t.column(c).to_numpy() for c in ("key", "doc", "tag"))
        if len(key):
            order, chosen = choose(key, doc, tag)
            mine = np.zeros(len(key), bool)
            mine[order[chosen]] = True
            one = t.column("own").combine_chunks().is_null().to_numpy(zero_copy_only=False)
            if (mine & one).any():
                yield _singles(doc[mine & one], tag[mine & one])
            if (mine & ~one).any():
                yield from t.filter(pa.array(mine & ~one)).select(["doc", "own"]).to_batches()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, k1, k2) of documents that have a window: 128 bits for the whole sequence of words."""
    for batch in batches:
        raw, at = core.text_bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        for first, last in core.chunks(at):
            words, begin = core.word_hashes(raw[at[first] : at[last]], at[first : last + 1] - at[first])
            some = np.flatnonzero(np.diff(begin) >= WINDOW)
            if len(some):
                k1, k2 = span_hashes(words, begin[some], begin[some + 1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[first:last][some]), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))], ["doc", "k1", "k2"])


def _in_several(key, doc, tag):
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    s, e = core.runs(key)
    return order, np.repeat(doc[s] != doc[e - 1], e - s)


def _not_first(key, doc, tag):
    check = tag >> 32
    order = np.lexsort((doc, check, key))
    key, doc, check = key[order], doc[order], check[order]
    new = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
    s = np.flatnonzero(new)
    least = np.repeat(doc[s], np.diff(np.append(s, len(doc))))
    return order, doc > least


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up = core._powers(np.uint64(k), n + 1)
    return up, core._powers(np.uint64(pow(k, -1, 1 << 64)), n + 1)


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words in each span."""
    out = []
    for k in (_K1, _K2):
        up, down = _powers(k, len(words))
        total = np.append(np.uint64(0), np.cumsum(words * up[: len(words)], dtype=np.uint64))
        out.append(core.mix((total[end] - total[start]) * down[start]))
    return out[0], out[1]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of documents with the spans of starts to look at (doc_id, text, spans)."""
    known = Known()
    for batch in batches:
        raw, at = core.text_bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        spans = batch.column(2)
        for first, last in core.chunks(at):
            words, begin = core.word_hashes(raw[at[first] : at[last]], at[first : last + 1] - at[first])
            marks = np.zeros(len(words) + 1, np.int64)
            for i in range(first, last):
                x = np.concatenate([np.frombuffer(y.as_buffer(), np.int64) for y in spans[i].values])
                most = begin[i - first + 1] - begin[i - first] - WINDOW
                a, b = x >> 32, np.minimum(x & 0xFFFFFFFF, most)
                a, b = a[a <= b], b[a <= b]
                np.add.at(marks, a + begin[i - first], 1)
                np.add.at(marks, b + 1 + begin[i - first], -1)
            start = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            if not len(start):
                continue
            key, check = span_hashes(words, start, start + WINDOW)
            check = (check >> np.uint64(33)).astype(np.int64)
            local = np.searchsorted(begin, start, "right") - 1
            doc, place = ids[first:last][local], start - begin[local]
            order = np.lexsort((place, doc, check, key))
            key, check, doc, tag = key[order], check[order], doc[order], check[order] << 32 | place[order]
            new = np.append(True, (key[1:] != key[:-1]) | (check[1:] != check[:-1]))
            s = np.flatnonzero(new)
            e = np.append(s[1:], len(key))
            sent = known.least(key[s], check[s])
            # where this task has the window in a smaller document, the place is settled
            later = doc > np.repeat(np.minimum(doc[s], sent), e - s)
            yield from _settled(_packed(doc[later], tag[later]))
            mine = doc[s] <= sent
            end = s + np.add.reduceat((~later).astype(np.int64), s)
            yield from _open(key, doc, tag, s[mine], end[mine])
            hot = s[mine & (end < e)]
            known.add(key[hot], check[hot], doc[hot])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, places, copy, mixed): a copy goes whole; places of a doc_id with several texts
    count where this text has the window that they stand for."""
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, places, copy, mixed in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
            words = (text.as_py() or "").encode().split()
            n_words.append(len(words))
            if copy.is_valid:
                words = []
            elif places.is_valid:
                tag = np.concatenate([np.frombuffer(y.as_buffer(), np.int64) for y in places.values])
                start, check = tag & 0xFFFFFFFF, tag >> 32
                fits = start + WINDOW <= len(words)
                start, check = start[fits], check[fits]
                if mixed.is_valid and len(start):
                    raw, at = core.text_bytes(pa.array([text.as_py()]))
                    own = span_hashes(core.word_hashes(raw, at)[0], start, start + WINDOW)[1]
                    start = start[(own >> np.uint64(33)).astype(np.int64) == check]
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + WINDOW, -1)
                stay = (np.cumsum(gone[:-1]) == 0).tolist()
                words = [w for w, s in zip(words, stay, strict=True) if s]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row of docs (doc_id, text).

    The texts are shuffled once: both joins ask for the same exchange, which Spark reuses."""
    core.small_batches(docs.sparkSession)
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", "text")  # an alias here would make the two exchanges differ
    named = docs.where("doc_id is not null")
    # what repeats a smaller document whole goes whole, and has nothing to tell about others
    whole = core.cut(named.mapInArrow(_whole, "doc long, k1 long, k2 long"), "whole")
    firsts = core.cut(whole.groupBy("k1", "k2").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    several = whole.groupBy(F.col("doc").alias("doc_id")).agg(*[f(k).alias(f"{n}_{k}") for k in ("k1", "k2") for n, f in (("lo", F.min), ("hi", F.max))])
    mixed = core.cut(several.where("lo_k1 != hi_k1 or lo_k2 != hi_k2").select("doc_id", F.lit(1).alias("mixed")), "mixed")
    copies = whole.join(firsts, ["k1", "k2"]).where("doc > first").select(F.col("doc").alias("doc_id")).distinct()
    copies = core.cut(copies.join(mixed, "doc_id", "left_anti").withColumn("copy", F.lit(1)), "copies")
    core.drop_cut(whole)
    core.drop_cut(firsts)
    rows = "key long, doc long, tag long, own binary"
    found = named.join(copies, "doc_id", "left_anti").mapInArrow(_shared_symbols, rows)
    shared = found.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _held(it, _in_several), "doc long, own binary")
    spans = shared.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("own").alias("spans"))
    met = named.join(spans.hint("merge"), "doc_id").select("doc_id", "text", "spans")
    repeats = met.mapInArrow(_windows, rows).repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _held(it, _not_first), "doc long, own binary")
    places = repeats.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("own").alias("places"))
    out = named.join(places.hint("merge"), "doc_id", "left").join(copies, "doc_id", "left").join(mixed, "doc_id", "left").select("doc_id", "text", "places", "copy", "mixed")
    none = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("places"), F.lit(None).cast("int").alias("copy"), F.lit(None).cast("int").alias("mixed"))
    return out.unionByName(none).mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")


def digests(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
