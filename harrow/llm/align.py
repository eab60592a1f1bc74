"""Two tokenizers over one text: groups of tokens with common ends, overlapping tokens, and how often
the pairs of ids overlap in the whole corpus.

The texts are encoded once and their ids written. A first pass gathers the distinct pairs of ids; they are
dealt to shards by a hash, and each shard becomes a minimal perfect hash (levels of bits: at a level the
pairs that are alone at their place are set, the others go on; a pair's number is the count of bits before
its own). The second pass aligns again: every task counts links in a dense vector under these numbers, the
vectors are summed block by block in a tree, and a last look at the documents takes the sums. Every number
is verified against the pair kept there. The pairs are dealt to bands of second ids with at most `most`
pairs, one band at a time in memory, however many there are.

Defined results: texts that are null or empty, or whose tokens do not spell the text with a space before it,
have no tokens: empty ids, zeros, empty `groups`. Repeated rows are aligned, and count, each. All columns
stay but the text; `a`, `b` and the measures replace columns of these names. No rows, no pairs: no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core, pieces
from .bpe import WHITE, byte_letters

#: Pairs of ids in memory at once (more only where one second id has more: as many as there are first ids): their keys and counts take 16 bytes each in the driver and in every worker.
MOST_PAIRS = 4_000_000
#: Pairs of a shard, built in one task; entries of a block of the count vector; vectors that one node sums.
SHARD, BLOCK, FAN = 1 << 16, 1 << 14, 64
#: Distinct pairs that a task holds before it hands them on.
HELD = 2_000_000
#: Fixed value: how the byte-level vocabulary splits texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The library's splitting runs out of stack in runs of white space that are much longer than this.
LONG_SPACE = re.compile(f"[{WHITE}]{{1000,}}")
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_ONE = np.uint64(1)


def read_byte_vocabulary(path: str) -> dict:
    """bytes -> id of a byte-level vocabulary whose ids are in the order of its merges."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    spec = json.loads(raw)
    kind, model = spec["pre_tokenizer"], spec["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in merges]
    if spec["normalizer"] or kind["type"] != "ByteLevel" or not kind.get("use_regex", True) or kind["add_prefix_space"] or model.get("ignore_merges") or ids != sorted(ids):
        raise ValueError("not a byte-level vocabulary of this kind")
    byte = {c: b for b, c in enumerate(byte_letters())}
    return {"ranks": {bytes(byte[c] for c in t): i for t, i in model["vocab"].items()}, "name": hashlib.sha256(raw.encode()).hexdigest()}


# ---------------------------------------------------------------- tokens


class Coders:
    """Both encoders of a worker."""

    def __init__(self, a: dict, b: dict):
        import tiktoken

        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=a["ranks"], special_tokens={})
        self.b = pieces.Codec(b)

    def first(self, text: str) -> list[int]:
        """Byte-level ids. A long run of white space is one piece; its last letter belongs to what follows."""
        ids, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            ids += self.a.encode_ordinary(text[at : run.start()]) + self.a._core_bpe.encode_single_piece(text[run.start() : end].encode())
            at = end
        return ids + self.a.encode_ordinary(text[at:])

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        a = [np.array(self.first(" " + t), "<u4").tobytes() if t else b"" for t in texts]
        b = self.b.encode(texts, ends=False)
        spelled = self.b.bytes
        for i, t in enumerate(texts):
            if t and b"".join(map(spelled.__getitem__, memoryview(b[i]).cast("I"))) != b" " + t.encode():
                a[i] = b[i] = b""
        return a, b


_CODERS: dict[str, Coders] = {}


def tokens(docs: DataFrame, byte_vocabulary: str, piece_model: str, text: str = "text") -> DataFrame:
    """docs without their text but with `a` and `b`, the ids (little-endian 32-bit) of both encoders."""
    spark = docs.sparkSession
    core.small_batches(spark)
    a, b = read_byte_vocabulary(byte_vocabulary), pieces.read_model(piece_model)
    name, sent = a["name"] + b["name"], spark.sparkContext.broadcast((a, b))
    others = [c for c in docs.columns if c not in (text, "a", "b")]
    fields = [docs.schema[c] for c in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _CODERS:
            _CODERS.clear()
            _CODERS[name] = Coders(*sent.value)
        for batch in batches:
            found = _CODERS[name].encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), *(pa.array(x, pa.binary()) for x in found)], [*others, "a", "b"])

    kept = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`"))
    return kept.mapInArrow(run, T.StructType([*fields, T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())]))


class Lengths:
    """Bytes of every id, and ids as decimal digits."""

    def __init__(self, a: dict, b: dict):
        self.a = np.zeros(max(a["ranks"].values()) + 1, np.int64)
        for t, i in a["ranks"].items():
            self.a[i] = len(t)
        self.b = np.array([1 if k == pieces._BYTE else len(p.replace(pieces.SPACE, " ").encode()) for p, k in zip(b["pieces"], b["kinds"], strict=True)], np.int64)
        n = max(len(self.a), len(self.b))
        shown = [str(i).encode() for i in range(n)]
        self.n_digits = np.array(list(map(len, shown)))
        wide = int(self.n_digits.max()) + 1
        self.digits = np.frombuffer(b"".join(x.ljust(wide) for x in shown), np.uint8).reshape(n, wide)


class Aligned:
    """Alignment of documents one after another: first[i] counts what the documents before i have."""

    def __init__(self, a: pa.Array, b: pa.Array, lengths: Lengths):
        self.lengths = lengths
        (self.a, self.first_a), (self.b, self.first_b) = ((np.frombuffer(b"".join(x.to_pylist()), "<u4").astype(np.int64), np.append(0, np.cumsum(pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) // 4))) for x in (a, b))
        self.end_a, self.end_b = np.cumsum(lengths.a[self.a]), np.cumsum(lengths.b[self.b])
        mark = np.zeros(int(self.end_a[-1]) + 1 if len(self.a) else 1, np.uint8)
        mark[self.end_a] = 1
        mark[self.end_b] += 2
        until = np.append(0, self.end_a)[self.first_a]  # bytes up to each document
        ends = np.flatnonzero(mark)
        kind = mark[ends]
        # two tokens overlap in one stretch without ends inside: a link ends at each end
        of_a, of_b = kind & 1, kind >> 1
        self.link_a, self.link_b = (np.cumsum(of, dtype=np.int64) - of for of in (of_a, of_b))
        self.common = ends[kind == 3]
        self.first_link, self.first_group = np.searchsorted(ends, until, "right"), np.searchsorted(self.common, until, "right")

    def keys(self) -> np.ndarray:
        """The pair of ids of each link, as one number."""
        return self.b[self.link_b] * len(self.lengths.a) + self.a[self.link_a]

    def groups(self) -> list[str]:
        """The groups of each document, written as `a1,a2|b1;a3|b2,b3`."""
        of_a, of_b = np.searchsorted(self.common, self.end_a), np.searchsorted(self.common, self.end_b)
        at_a = np.arange(len(self.a)) + np.searchsorted(of_b, of_a, "left")
        at_b = np.arange(len(self.b)) + np.searchsorted(of_a, of_b, "right")
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        mark = np.full(len(ids), ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        mark[at_a[self.end_a == self.common[of_a]]] = ord("|")
        mark[at_b[self.end_b == self.common[of_b]]] = ord(";")
        width = self.lengths.n_digits[ids]
        shown = self.lengths.digits[ids]
        shown[np.arange(len(ids)), width] = mark
        raw = shown[np.arange(shown.shape[1]) <= width[:, None]].tobytes()
        at = np.append(0, np.cumsum(width + 1))[self.first_a + self.first_b].tolist()
        return [raw[i : max(i, j - 1)].decode() for i, j in zip(at, at[1:], strict=False)]


def _parts(batches: Iterator[pa.RecordBatch], lengths: Lengths) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """The batches in runs of documents of some 2 MB of ids, aligned."""
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(c)) for c in "ab")
        for i, j in core.chunks(np.append(0, np.cumsum(pc.binary_length(a).to_numpy(zero_copy_only=False).astype(np.int64)))):
            yield batch.slice(i, j - i), Aligned(a.slice(i, j - i), b.slice(i, j - i), lengths)


# ---------------------------------------------------------------- minimal perfect hash


def _place(keys: np.ndarray, level: np.ndarray | int, size: np.ndarray) -> np.ndarray:
    """A place below `size` for each key at a level."""
    with np.errstate(over="ignore"):
        h = core.mix(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1))
    return ((h >> np.uint64(32)) * size.astype(np.uint64)) >> np.uint64(32)


def _shard(keys: np.ndarray, n: int) -> np.ndarray:
    return ((core.mix(keys.view(np.uint64)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Words of 64 bits at each level, the words, and the keys in the order of their numbers."""
    left, sizes, words, order, level = np.sort(keys), [], [], [], 0
    while len(left):
        size = 64 * (len(left) // 32 + 1)  # two places a key, in whole words
        at = _place(left, level, np.full(len(left), size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        order.append(left[alone][np.argsort(at[alone])])
        sizes.append(size // 64)
        left, level = left[~alone], level + 1
    return sizes, np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate([np.zeros(0, np.int64), *order])


class PairHash:
    """Numbers 0..n-1 for the distinct pairs of a band, one hash a shard."""

    def __init__(self, shards: list[tuple[int, list[int], bytes, bytes]], n_shards: int):
        self.n_shards = n_shards
        levels = max([len(s[1]) for s in shards], default=0)
        self.sizes = np.zeros((levels, n_shards), np.int64)
        self.base = np.zeros((levels, n_shards), np.int64)
        words, keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for shard, sizes, raw, own in sorted(shards):
            self.sizes[: len(sizes), shard] = sizes
            self.base[: len(sizes), shard] = at + np.append(0, np.cumsum(sizes[:-1]))
            words.append(np.frombuffer(raw, np.uint64))
            keys.append(np.frombuffer(own, np.int64))
            at += sum(sizes)
        self.words, self.keys = np.concatenate(words), np.concatenate(keys)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; all must be among those that the hash was built of."""
        out = np.full(len(keys), -1, np.int64)
        shard, left = _shard(keys, self.n_shards), np.arange(len(keys))
        for level in range(len(self.sizes)):
            k, s = keys[left], shard[left]
            at = _place(k, level, 64 * self.sizes[level][s])
            word = self.base[level][s] + (at >> np.uint64(6)).astype(np.int64)
            np.minimum(word, len(self.words) - 1, out=word)
            bits, bit = self.words[word], at & np.uint64(63)
            hit = (bits >> bit) & _ONE == 1
            found = self.before[word[hit]] + np.bitwise_count(bits[hit] & ((_ONE << bit[hit]) - _ONE))
            out[left[hit]] = found
            left = left[~hit]
            if not len(left):
                break
        if len(left) or (self.keys[out] != keys).any():
            raise RuntimeError("a pair that the first pass has not met")
        return out


def _hashes(pairs: DataFrame, n: int) -> PairHash:
    """The hash of the n distinct numbers in `pair`, built shard by shard."""
    n_shards = n // SHARD + 1

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_shard(keys, n_shards)), batch.column(0)], ["shard", "pair"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in core.key_groups(batches, "shard"):
            shard, keys = table.column("shard").to_numpy(), table.column("pair").to_numpy()
            made = [(int(shard[i]), *build(keys[i:j])) for i, j in zip(*core.runs(shard), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2].tobytes() for m in made]), pa.array([m[3].tobytes() for m in made])], ["shard", "sizes", "words", "keys"])

    by_shard = pairs.select("pair").mapInArrow(dealt, "shard long, pair long").repartition("shard").sortWithinPartitions("shard")
    return PairHash([tuple(r) for r in by_shard.mapInArrow(built, "shard long, sizes array<long>, words binary, keys binary").collect()], n_shards)


# ---------------------------------------------------------------- counting and looking up


def _tree_sum(vectors: DataFrame, parts: int) -> DataFrame:
    """Sum (block, part, counts) to one vector a block; a node sums FAN at most."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for block, part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held != (block, part):
                    yield pa.RecordBatch.from_pydict({"block": [held[0]], "part": [held[1]], "counts": [total.tobytes()]})
                new = np.frombuffer(raw, np.int64)
                total = total + new if held == (block, part) else new
                held = block, part
        if held is not None:
            yield pa.RecordBatch.from_pydict({"block": [held[0]], "part": [held[1]], "counts": [total.tobytes()]})

    while parts > 1:
        node = vectors.withColumn("part", F.floor(F.col("part") / FAN))
        vectors = node.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(summed, "block long, part long, counts binary")
        parts = -(-parts // FAN)
    return vectors


def _band(key: np.ndarray, n_a: int, low: int, high: int) -> np.ndarray:
    return (key >= low * n_a) & (key < high * n_a)


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, text: str = "text", groups: bool = True, most: int = MOST_PAIRS) -> DataFrame:
    """docs without their text but with the ids `a` and `b`, the MEASURES (long) and, if asked for, `groups`."""
    spark = docs.sparkSession
    found = core.cut(tokens(docs.drop(*MEASURES, "groups"), byte_vocabulary, piece_model, text), "tokens")
    lengths = Lengths(read_byte_vocabulary(byte_vocabulary), pieces.read_model(piece_model))
    sizes, n_a, n_b = spark.sparkContext.broadcast(lengths), len(lengths.a), len(lengths.b)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, new, n = np.zeros(0, np.int64), [], 0
        for _, al in _parts(batches, sizes.value):
            new.append(np.unique(al.keys()))
            n += len(new[-1])
            if n > HELD:
                seen, new = np.unique(np.concatenate([seen, *new])), []
                n = 0
                if len(seen) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(seen)], ["pair"])
                    seen = seen[:0]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([seen, *new])))], ["pair"])

    pairs = core.cut(found.select("a", "b").mapInArrow(distinct, "pair long").distinct(), "pairs")
    # bands of second ids; a row an id reaches the driver
    held = {r["b"]: r["n"] for r in pairs.groupBy(F.floor(F.col("pair") / n_a).cast("long").alias("b")).agg(F.count("*").alias("n")).collect()}
    bands, low, n = [], 0, 0
    for b in range(n_b):
        if n and n + held.get(b, 0) > most:
            bands.append((low, b, n))
            low, n = b, 0
        n += held.get(b, 0)
    bands.append((low, n_b, n))

    n_parts = max(1, found.rdd.getNumPartitions())
    zero = F.lit(0).cast("long")
    out = found.withColumns({m: zero for m in MEASURES}) if len(bands) > 1 else found
    for k, (low, high, n) in enumerate(bands):
        own = _hashes(pairs.where((F.col("pair") >= low * n_a) & (F.col("pair") < high * n_a)), n)
        numbers = spark.sparkContext.broadcast(own)

        def counted(batches: Iterator[pa.RecordBatch], numbers=numbers, low=low, high=high, n=n) -> Iterator[pa.RecordBatch]:
            total, waiting, m = np.zeros(n, np.int64), [], 0
            for _, al in _parts(batches, sizes.value):
                key = al.keys()
                waiting.append(numbers.value.numbers(key[_band(key, n_a, low, high)]))
                m += len(waiting[-1])
                if m > n:
                    total += np.bincount(np.concatenate(waiting), minlength=n)
                    waiting, m = [], 0
            if m:
                total += np.bincount(np.concatenate(waiting), minlength=n)
            part = TaskContext.get().partitionId()
            for block in range(0, n, BLOCK):
                if total[block : block + BLOCK].any():
                    yield pa.RecordBatch.from_pydict({"block": [block], "part": [part], "counts": [total[block : block + BLOCK].tobytes()]})

        counts = np.zeros(n, np.int64)
        for r in _tree_sum(found.select("a", "b").mapInArrow(counted, "block long, part long, counts binary"), n_parts).collect():
            counts[r["block"] : r["block"] + BLOCK] += np.frombuffer(r["counts"], np.int64)
        best = np.zeros(n_b, np.int64)
        np.maximum.at(best, own.keys // n_a, counts)
        sums, last = spark.sparkContext.broadcast((counts, counts == best[own.keys // n_a])), k == len(bands) - 1
        others = [c for c in out.columns if c not in MEASURES]
        fields = [*(out.schema[c] for c in others), *(T.StructField(m, T.LongType()) for m in MEASURES)] + [T.StructField("groups", T.StringType())] * (last and groups)

        def looked(batches: Iterator[pa.RecordBatch], numbers=numbers, sums=sums, low=low, high=high, last=last, others=others, first=k == 0) -> Iterator[pa.RecordBatch]:
            counts, is_best = sums.value
            for batch, al in _parts(batches, sizes.value):
                key = al.keys()
                inside = _band(key, n_a, low, high)
                number = numbers.value.numbers(key[inside])
                at = np.append(0, np.cumsum(inside))[al.first_link - al.first_link[0]]
                more = [np.diff(np.append(0, np.cumsum(x[number], dtype=np.int64))[at]) for x in (is_best, counts)]
                if not first:
                    more = [x + batch.column(batch.schema.get_field_index(c)).to_numpy() for x, c in zip(more, MEASURES[4:], strict=True)]
                own = [np.diff(x) for x in (al.first_a, al.first_b, al.first_group, al.first_link)]
                columns = [*(batch.column(batch.schema.get_field_index(c)) for c in others), *(pa.array(x.astype(np.int64)) for x in (*own, *more))]
                if last and groups:
                    columns.append(pa.array(al.groups(), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

        out = out.mapInArrow(looked, T.StructType(fields))
        if not last:
            out = core.cut(out, "band")
    core.drop_cut(pairs)
    return out


def digests(docs: DataFrame, byte_vocabulary: str, piece_model: str) -> DataFrame:
    """doc_id, the measures and groups_sha256 of every text."""
    out = align(docs.select("doc_id", "text"), byte_vocabulary, piece_model)
    return out.select("doc_id", *MEASURES, F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
