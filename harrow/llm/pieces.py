"""Byte-pair encoding over sentence pieces with a given model file (never trained here).

The words of a batch that the worker does not remember are encoded together: one flat array of symbols,
beside it the rank of every pair of neighbours. A round takes the lowest rank of each word (a segmented
minimum), merges all its places at once, leftmost first where they overlap, and closes the gaps; words in
which nothing can merge leave. A place whose merge would give a pair of no higher rank ends its word's
round, as that pair is then next: so the order is that of one merge at a time.

Defined results: null and empty texts have the begin and end ids only (nothing without them) and decode to
an empty text; repeated rows are encoded each; all columns of the input stay, and `ids`, `decoded` replace
columns of that name. Letters without a piece become byte pieces. Model files of another kind (unigram,
user-defined or unused pieces, another normalizer, no byte pieces) are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

SPACE = "▁"
NEVER = np.int64(1) << 40
#: Words that a worker remembers in a generation; those not met in a whole generation are forgotten.
CACHE_WORDS = 200_000
#: A longer word in which a round would stop early is merged one pair at a time, by a heap.
SHORT = 64
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6

codecs.register_error("harrow.each", lambda e: ("�", e.start + 1))


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield tag >> 3, raw[at : at + size]
            at += size


def read_model(path: str) -> dict:
    """What encoding needs of a model file: pieces, scores and kinds, small enough for every worker."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces, scores, kinds, prefix = [], [], [], True
    model, normalizer, bos, eos = 1, {}, 1, 2
    for number, value in _fields(raw):
        if number == 1:
            got = dict(_fields(value))
            pieces.append(got[1].decode())
            scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
            kinds.append(got.get(3, _NORMAL))
        elif number == 2:
            got = dict(_fields(value))
            model, bos, eos = got.get(3, 1), got.get(41, 1), got.get(42, 2)
        elif number == 3:
            normalizer = dict(_fields(value))
            prefix = bool(normalizer.get(3, 1))
    if model != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or not prefix:
        raise ValueError("not a byte-pair model over unchanged texts with a space before them")
    if {*kinds} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or kinds.count(_BYTE) != 256:
        raise ValueError("user-defined or unused pieces, or no byte pieces")
    return {"pieces": pieces, "scores": scores, "kinds": kinds, "bos": bos, "eos": eos, "name": hashlib.sha256(raw).hexdigest()}


class Merges:
    """Which neighbours merge, in which order, and to what."""

    def __init__(self, spec: dict):
        pieces, kinds = spec["pieces"], spec["kinds"]
        normal = [i for i, k in enumerate(kinds) if k == _NORMAL]
        symbol = {pieces[i]: i for i in normal}
        for c in sorted({c for i in normal for c in pieces[i]} - set(symbol)):  # letters that are no piece of their own
            symbol[c] = len(pieces) + len(symbol) - len(normal)
        self.n, self.n_pieces = len(pieces) + len(symbol) - len(normal), len(pieces)
        self.byte_ids = np.array([i for i, k in enumerate(kinds) if k == _BYTE], np.int64)
        self.letters = {i: c for c, i in symbol.items() if i >= len(pieces)}
        self.of_letter = np.zeros(0x110000, np.int32)
        self.of_letter[:] = -1 - np.arange(0x110000)  # without a symbol: itself, below zero
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_letter[ord(s)] = i
        order = np.unique([-spec["scores"][i] for i in normal])
        rank = dict(zip(normal, np.searchsorted(order, [-spec["scores"][i] for i in normal]).tolist(), strict=True))
        found = [(symbol[s[:k]] * self.n + symbol[s[k:]], rank[i], i) for i in normal for s in [pieces[i]] for k in range(1, len(s)) if s[:k] in symbol and s[k:] in symbol]
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.keys = np.append(table[:, 0], np.iinfo(np.int64).max)
        self.ranks, self.results = np.append(table[:, 1], NEVER), np.append(table[:, 2], -1)
        #: no piece goes on with a space after another letter, so texts can be cut there
        self.cut = not any(SPACE in pieces[i].lstrip(SPACE) for i in normal)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.n + right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NEVER), np.where(hit, self.results[at], -1)

    def one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """The merges of one word by a heap of (rank, place)."""
        n, s = len(symbols), symbols.tolist()
        rank, result = self.look(symbols[:-1], symbols[1:])
        heap = [(int(rank[i]), i, s[i], s[i + 1], int(result[i])) for i in np.flatnonzero(rank < NEVER).tolist()]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def put(i: int, j: int) -> None:
            pair = s[i], s[j]
            if pair not in known:
                r, z = self.look(np.array([s[i]]), np.array([s[j]]))
                known[pair] = int(r[0]), int(z[0])
            r, z = known[pair]
            if r < NEVER:
                heapq.heappush(heap, (r, i, *pair, z))

        gone = [False] * n
        while heap:
            _, i, a, b, z = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or s[i] != a or s[j] != b:
                continue
            s[i], gone[j] = z, True
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                put(i, k)
            if before[i] >= 0:
                put(before[i], i)
        return np.array([x for x, g in zip(s, gone, strict=True) if not g], np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the (non-empty) words after all merges, and the word of each."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        length = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, word = self.of_letter[code].astype(np.int64), np.repeat(np.arange(len(words)), length)
        ends = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
        rank, result = np.full(len(sym), NEVER), np.full(len(sym), -1, np.int64)
        rank[:-1], result[:-1] = self.look(sym[:-1], sym[1:])
        rank[ends] = NEVER
        while len(sym):
            first, last = core.runs(word)
            least = np.minimum.reduceat(rank, first)
            done = least == NEVER
            if done.any():
                stay = np.repeat(~done, last - first)
                out.append((sym[~stay], word[~stay]))
                sym, word, rank, result, ends = (x[stay] for x in (sym, word, rank, result, ends))
                continue
            low = np.repeat(least, last - first)
            hit = rank == low
            # among overlapping places every other one, from the left
            begin = hit & ~np.append(False, hit[:-1])
            at = np.arange(len(hit))
            since = at - np.maximum.accumulate(np.where(begin, at, 0))
            c = np.flatnonzero(hit & (since % 2 == 0))
            z, w = result[c], word[c]
            chosen = np.zeros(len(sym) + 2, bool)
            chosen[c] = True
            left = np.where(c > 0, sym[c - 1], -1)
            joined = (c > 1) & chosen[c - 2]
            left[joined] = result[c[joined] - 2]
            left[(c == 0) | (word[c - 1] != w)] = -1
            on = np.minimum(c + 2, len(sym) - 1)
            right = np.where((c + 2 < len(sym)) & (word[on] == w), sym[on], -1)
            lower = np.minimum(self.look(left, z)[0], self.look(z, right)[0]) <= low[c]
            if lower.any():  # what comes after it in its word has to wait
                seen = np.cumsum(lower) - lower
                of = np.append(True, w[1:] != w[:-1])
                before = np.maximum.accumulate(np.where(of, seen, 0))
                c = c[seen == before]
                z, w = result[c], word[c]
                for k in np.unique(word[c[lower[seen == before]]]).tolist():
                    i, j = np.searchsorted(word, [k, k + 1])
                    if j - i > SHORT:
                        own = (w == k).nonzero()[0]
                        alone = self.one_by_one(sym[i:j])
                        out.append((alone, np.full(len(alone), k)))
                        rank[i:j] = NEVER - 1  # leaves below
                        c, z, w = np.delete(c, own), np.delete(z, own), np.delete(w, own)
            sym[c], ends[c] = z, ends[c + 1]
            stay = np.ones(len(sym), bool)
            stay[c + 1] = False
            stay &= rank != NEVER - 1
            place = np.cumsum(stay) - 1
            sym, word, rank, result, ends = (x[stay] for x in (sym, word, rank, result, ends))
            c = place[c]
            fresh = np.zeros(len(sym), bool)
            fresh[c] = True
            fresh[c[c > 0] - 1] = True
            rank[fresh], result[fresh] = NEVER, -1
            inner = np.flatnonzero(fresh & ~ends)
            rank[inner], result[inner] = self.look(sym[inner], sym[inner + 1])
        symbols, word = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]


class Codec(dict):
    """word -> its ids as little-endian 32-bit numbers, filled as words are met."""

    def __init__(self, spec: dict):
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.merges = Merges(spec)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if self.merges.cut else "(?s).+").findall
        self.bytes = [bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(spec["pieces"], spec["kinds"], strict=True)]
        self.control = {i for i, k in enumerate(spec["kinds"]) if k == _CONTROL}
        self.spaced = {i for i, p in enumerate(spec["pieces"]) if p.startswith(SPACE)}
        self.bos, self.eos = struct.pack("<I", spec["bos"]), struct.pack("<I", spec["eos"])

    def _ids(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols: letters without a piece become byte pieces."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= self.merges.n_pieces))
        if len(odd):
            spelled = [(chr(-1 - s) if s < 0 else self.merges.letters[s]).encode("utf-8", "surrogatepass") for s in symbols[odd].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[odd] = list(map(len, spelled))
            at = np.repeat((symbols < 0) | (symbols >= self.merges.n_pieces), times)
            symbols, word = np.repeat(symbols, times), np.repeat(word, times)
            symbols[at] = self.merges.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        return symbols, word

    def learn(self, words: set[str]) -> None:
        """Encode those of the words that are not known yet, all together."""
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        new = []
        for w in words:
            if w not in self:
                ids = self.old.pop(w, None)
                if ids is None:
                    new.append(w)
                else:
                    self[w] = ids
        ids, word = self._ids(*self.merges.encode(new))
        raw, at = ids.astype("<u4").tobytes(), (4 * np.searchsorted(word, np.arange(len(new) + 1))).tolist()
        for w, a, b in zip(new, at, at[1:], strict=False):
            self[w] = raw[a:b]

    def encode(self, texts: list[str | None], ends: bool = True) -> list[bytes]:
        """The ids of each text, in its begin and end ids if `ends`."""
        spelled = [self.words(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn(set().union(*spelled))
        get = self.__getitem__
        if ends:
            return [b"".join((self.bos, *map(get, s), self.eos)) for s in spelled]
        return [b"".join(map(get, s)) for s in spelled]

    def decode(self, ids: bytes) -> str:
        table, got = self.bytes, memoryview(ids).cast("I")
        raw = b"".join(map(table.__getitem__, got))
        drop = raw[:1] == b" " and next(i for i in got if i not in self.control) in self.spaced  # encoding has put it there
        try:
            return raw[drop:].decode()
        except UnicodeDecodeError:  # bytes that are no letter; those around a control piece do not join
            parts, held = [], b""
            for i in got:
                held += table[i]
                if i in self.control:
                    parts.append(held)
                    held = b""
            return "".join(p.decode("utf-8", "harrow.each") for p in [*parts, held])[drop:]


_CODECS: dict[str, Codec] = {}


def codec_of(name: str, spec) -> Codec:
    """This process's codec of the model with that digest, made once from the broadcast."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(spec.value)
    return _CODECS[name]


def transcode(docs: DataFrame, model: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """docs with `ids` (binary, little-endian 32-bit numbers, begin and end included) and, unless decoded
    is false, `decoded`, the text that the ids stand for. One pass, no shuffle."""
    spark = docs.sparkSession
    core.small_batches(spark)
    read = read_model(model)
    name, spec = read["name"], spark.sparkContext.broadcast(read)
    docs = docs.drop("ids", "decoded")
    fields = [*docs.schema.fields, T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(name, spec)
        for batch in batches:
            ids = codec.encode(batch.column(batch.schema.get_field_index(text)).to_pylist())
            more = [pa.array(ids, pa.binary())]
            if decoded:
                more.append(pa.array([codec.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "ids", "decoded"][: len(fields)])

    return docs.mapInArrow(run, T.StructType(fields))


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    out = transcode(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
