"""Byte-pair encoding and decoding with a given vocabulary file (never trained here).

A word's adjacent pairs are the leaves of a segment tree that holds (rank, position); the root is
the leftmost pair of lowest rank. A merge updates three leaves in logarithmic time, until the root
says that nothing can merge. Words recur, so each worker process keeps a bounded cache of encoded words,
from task to task.

Defined results: null and empty texts have no tokens (empty ids, empty decoded text); repeated rows
are encoded each; all columns of the input stay, and `ids`, `decoded` replace columns of that name.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

NONE = 1 << 62
LOW = (1 << 32) - 1
#: Words that a worker remembers in a generation. When one is full it becomes the old one, and words that
#: were not met since the last time are forgotten.
CACHE_WORDS = 200_000
#: White space as the vocabulary's normalizer knows it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """What encoding needs of a tokenizer file, small enough to send to every worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "vocab": model["vocab"],
        "merges": [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]],
        "suffix": model.get("end_of_word_suffix") or "",
        "added": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "pattern": pattern.replace(r"^\s\p", f"^{WHITE}\\p"),
    }


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge the leftmost pair of lowest rank until none is left; pairs: (rank << 32, symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1
    while size < n - 1:
        size *= 2
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        found = pairs.get((symbols[i], symbols[i + 1]))
        if found:
            tree[size + i] = found[0] | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, key: int) -> None:
        k = size + i
        if tree[k] == key:
            return
        tree[k] = key
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            if b < a:
                a = b
            if tree[k] == a:  # and so are all above
                return
            tree[k] = a

    while tree[1] != NONE:
        i = tree[1] & LOW
        j = after[i]
        symbols[i] = pairs[symbols[i], symbols[j]][1]
        symbols[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, NONE)
        if k < n:
            before[k] = i
            found = pairs.get((symbols[i], symbols[k]))
            put(i, found[0] | i if found else NONE)
        else:
            put(i, NONE)
        h = before[i]
        if h >= 0:
            found = pairs.get((symbols[h], symbols[i]))
            put(h, found[0] | h if found else NONE)
    return [s for s in symbols if s >= 0]


class Codec(dict):
    """word -> its ids as little-endian 32-bit numbers, filled as words are met."""

    def __init__(self, spec: dict):
        super().__init__()
        self.old: dict[str, bytes] = {}
        vocab, suffix = spec["vocab"], spec["suffix"]
        self.pairs = {(vocab[a], vocab[b]): (rank << 32, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(spec["merges"]))) if a in vocab and b in vocab and a + b in vocab}
        letters = byte_letters()
        self.inner, self.last = [vocab.get(c, -1) for c in letters], [vocab.get(c + suffix, -1) for c in letters]
        self.added = spec["added"]
        self.tokens = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        self.words = regex.compile(spec["pattern"]).findall
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        out = self.old.pop(word, None)
        if out is not None:
            self[word] = out
            return out
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        out = array("I", merge([i for i in ids if i >= 0], self.pairs)).tobytes()
        self[word] = out
        return out

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # letters become small one by one: no special sigma at the end of a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.__getitem__, self.words(text.lower())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split is None or "<" not in text:
            return self._plain(text)
        parts = self.split(text)
        return b"".join(array("I", [self.added[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, array("I", ids)))


_CODECS: dict[str, Codec] = {}


def codec_of(name: str, spec) -> Codec:
    """This process's codec of the vocabulary with that digest, made once from the broadcast."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(spec.value)
    return _CODECS[name]


def transcode(docs: DataFrame, vocabulary: str, text: str = "text", decoded: bool = True) -> DataFrame:
    """docs with `ids` (binary, little-endian 32-bit numbers) and, unless decoded is false,
    `decoded`, the text that the ids stand for. One pass, no shuffle."""
    spark = docs.sparkSession
    core.small_batches(spark)
    spec = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    with open(vocabulary, "rb") as f:
        name = hashlib.sha256(f.read()).hexdigest()
    docs = docs.drop("ids", "decoded")
    fields = [*docs.schema.fields, T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decoded
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(name, spec)
        for batch in batches:
            ids = [codec.encode(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            more = [pa.array(ids, pa.binary())]
            if decoded:
                more.append(pa.array([codec.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "ids", "decoded"][: len(fields)])

    return docs.mapInArrow(run, T.StructType(fields))


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    out = transcode(docs.select("doc_id", "text"), vocabulary)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
