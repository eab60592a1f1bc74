"""Subword lattice likelihood: the probability of a text, summed over all its segmentations.

A text is a stream of words and one end symbol, drawn independently. A word is one whole edge of its
lattice, if training documents (all but every tenth by crc32) hold it, or a path of pieces of a given
vocabulary (never trained here), the first of which carries the space mark. With N words and T distinct
ones in training, E ends, c of this word and q the sum of its paths of pieces, its probability is
(c + T q) / (N + T + E), and the end's E / (N + T + E): what is spelled has the share that new words had
in training (Witten and Bell), and all words and the end sum to one. The vocabulary's scores are the
first weights of the pieces; `rounds` of expectation-maximisation over the distinct training words refit
them. The forward recursion is in log space, for many words of one length at once. A letter that the
vocabulary lacks is its UTF-8 bytes, as the vocabulary provides.

Word counts are joined by a 64-bit word hash. The HEAD most frequent words are sent to all workers (a
fixed bound); the others' counts come by a join, so frequent words never meet in one task.

Defined results: null and empty texts are the end symbol alone; repeated rows are scored each (and
counted each); a null doc_id counts as held out; with no training documents every word is spelled
by the weights as given, and T and E are 1; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

HEAD = 1 << 18
#: Refits of the piece weights; none: the vocabulary's scores stay.
EM_ROUNDS = 1
#: Added to every piece's expected count.
SMOOTH = 0.1
#: Distinct words of chunks that are merged before they leave a task.
MERGE = 1_000_000
#: Words whose lattices are summed together, so that each length has many.
TOGETHER = 50_000
#: Lattice cells computed at once.
CELLS = 1 << 20
MARK = "▁"
_K = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(path: str) -> tuple[list[str], np.ndarray]:
    """The normal pieces of a vocabulary file and the scores' weights: a score is minus a merge's
    rank there, and a piece's first weight falls with its rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores = [], []
    for i in range(model.get_piece_size()):
        if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i):
            continue
        p = model.id_to_piece(i)
        if MARK not in p[1:] and p.strip():
            pieces.append(p)
            scores.append(model.get_score(i))
    return pieces, 1.0 / (10.0 - np.maximum(scores, -1e6))


class Lattice:
    """pieces, then 256 bytes; logp in natural logarithms."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.n, self.logp = len(pieces), logp
        self.most = max(map(len, pieces))
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order.astype(np.int32)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(keys >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_K) + ord(c) + 1) & (1 << 64) - 1
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1; most substrings are none, which a table of bits tells first."""
        out = np.full(hashes.shape, -1, np.int32)
        some = self.seen[(hashes >> np.uint64(44)).view(np.int64)]
        todo = hashes[some]
        at = np.minimum(np.searchsorted(self.keys, todo), self.n - 1)
        out[some] = np.where(self.keys[at] == todo, self.ids[at], -1)
        return out

    def batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indexes, code points with the mark in front), words of one length at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            step = max(1, CELLS // int(n + 1))
            for s in range(0, len(at), step):
                rows = at[s : s + step]
                codes = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), n)
                yield rows, np.concatenate([np.full((len(rows), 1), ord(MARK), np.uint32), codes], axis=1)

    def edges(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per piece length: the piece from each position (-1: none, -2: bytes) and its log probability."""
        b, n = codes.shape
        h = np.zeros((b, n), np.uint64)
        out = []
        for size in range(1, min(self.most, n) + 1):
            h = h[:, : n - size + 1] * _K + codes[:, size - 1 :] + np.uint64(1)
            piece = self.find(h)
            lp = np.where(piece >= 0, self.logp[piece], -np.inf)
            if size == 1 and (piece < 0).any():
                strange = piece < 0
                letters, back = np.unique(codes[strange], return_inverse=True)
                lp[strange] = np.array([self.logp[self.n + np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8).astype(int)].sum() for c in letters])[back]
                piece[strange] = -2
            out.append((piece, lp))
        return out

    def forward(self, codes: np.ndarray, edges: list) -> np.ndarray:
        b, n = codes.shape
        alpha = np.zeros((b, n + 1))
        for j in range(1, n + 1):
            ways = [alpha[:, j - s] + edges[s - 1][1][:, j - s] for s in range(1, min(len(edges), j) + 1)]
            top = np.maximum.reduce(ways)
            alpha[:, j] = top + np.log(sum(np.exp(w - top) for w in ways))
        return alpha

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word, all segmentations together."""
        out = np.zeros(len(words))
        for rows, codes in self.batches(words):
            out[rows] = self.forward(codes, self.edges(codes))[:, -1]
        return out

    def expect(self, words: list[str], count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece and byte in the words, by forward and backward sums."""
        total = np.zeros(self.n + 256)
        for rows, codes in self.batches(words):
            edges = self.edges(codes)
            alpha = self.forward(codes, edges)
            b, n = codes.shape
            beta = np.zeros((b, n + 1))
            for i in range(n - 1, -1, -1):
                ways = [beta[:, i + s] + edges[s - 1][1][:, i] for s in range(1, min(len(edges), n - i) + 1)]
                top = np.maximum.reduce(ways)
                beta[:, i] = top + np.log(sum(np.exp(w - top) for w in ways))
            for s, (piece, lp) in enumerate(edges, 1):
                used = np.exp(alpha[:, : n - s + 1] + lp + beta[:, s:] - alpha[:, -1:]) * count[rows][:, None]
                known = piece >= 0
                total[: self.n] += np.bincount(piece[known], used[known], self.n)
                if s == 1:
                    for c, u in zip(codes[piece == -2].tolist(), used[piece == -2].tolist(), strict=True):
                        for byte in chr(c).encode("utf-8", "surrogatepass"):
                            total[self.n + byte] += u
        return total


def _spelled(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """Per chunk: first and last document, each word's index into the chunk's distinct words, where
    documents' words begin, the distinct words, their hashes, their counts."""
    raw, at = core.text_bytes(column)
    for first, last in core.chunks(at):
        part = core.LOWER[raw[at[first] : at[last]]]
        inner = at[first : last + 1] - at[first]
        hashes, begin = core.word_hashes(part, inner)
        distinct, where, back, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        space = core.SPACE[part]
        starts = ~space
        starts[1:] &= space[:-1]
        cuts = inner[(inner > 0) & (inner < len(part))]
        starts[cuts] = ~space[cuts]
        ends = ~space
        ends[:-1] &= space[1:]
        if len(cuts):
            ends[cuts - 1] = ~space[cuts - 1]
        a, b = np.flatnonzero(starts)[where], np.flatnonzero(ends)[where] + 1
        data = part.tobytes()
        yield first, last, back, begin, [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], distinct, count


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def merged() -> pa.RecordBatch:
        hashes, where, back = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
        count = np.bincount(back, np.concatenate([x[2] for x in held]).astype(float)).astype(np.int64)
        words = pa.concat_arrays([x[1] for x in held]).take(pa.array(where))
        return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), words, pa.array(count)], ["h", "word", "c"])

    for batch in batches:
        for *_, words, hashes, count in _spelled(batch.column(0)):
            held.append((hashes, pa.array(words, pa.binary()).cast(pa.string()), count))
            size += len(hashes)
            if size >= MERGE:
                yield merged()
                held, size = [], 0
    if held:
        yield merged()


def word_counts(texts: DataFrame) -> DataFrame:
    """h (hash), word, c of every distinct word; counted within chunks, then within tasks, then by shuffle."""
    return texts.select("text").mapInArrow(_count, "h long, word string, c long").groupBy("h", "word").agg(F.sum("c").alias("c"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def fit(counts: DataFrame, pieces: list[str], weights: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Log probabilities of pieces and bytes: from the given weights, refitted by rounds of EM over the
    distinct words, each once: words that training lacks are like those, not like its frequent ones.
    What reaches the driver is a sum for each piece of the vocabulary."""
    spark = counts.sparkSession
    uses = np.concatenate([weights, np.full(256, weights.min() / 256)])
    words = counts.count()
    uses *= 2.0 * max(words, 1) / uses.sum()
    for _ in range(rounds if words else 0):
        cast = spark.sparkContext.broadcast((pieces, _logs(uses)))

        def expected(batches: Iterator[pa.RecordBatch], cast=cast) -> Iterator[pa.RecordBatch]:
            lattice, total, words = Lattice(*cast.value), None, []
            for b in itertools.chain(batches, [None]):
                if b is not None:
                    words += b.column(0).to_pylist()
                if words and (b is None or len(words) >= TOGETHER):
                    part = lattice.expect(words, np.ones(len(words)))
                    total, words = part if total is None else total + part, []
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

        got = counts.select("word").mapInArrow(expected, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        uses = np.zeros(len(uses))
        uses[got["piece"].to_numpy()] = got["uses"].to_numpy()
    return _logs(uses)


def _logs(uses: np.ndarray) -> np.ndarray:
    uses = uses + SMOOTH
    return np.log(uses / uses.sum())


def score(docs: DataFrame, vocabulary: str, head: int = HEAD, rounds: int = EM_ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    core.small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    train = docs.where("not held_out")
    counts = core.cut(word_counts(train), "words")
    n_docs = train.count()
    sums = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = int(sums[0] or 0) + n_docs, int(sums[1]) + (n_docs > 0)
    pieces, weights = read_pieces(vocabulary)
    logp = fit(counts, pieces, weights, rounds)
    ends, types = max(n_docs, 1), max(int(sums[1]), 1)
    mass = int(sums[0] or 0) + types + ends
    rank, least = core.most_frequent(counts, "c", head)
    top = counts.where(rank >= least).select("h", "c").toPandas()
    order = np.argsort(top["h"].to_numpy().astype(np.int64).view(np.uint64))
    h, c = top["h"].to_numpy().astype(np.int64).view(np.uint64)[order], top["c"].to_numpy().astype(np.int64)[order]
    cast = spark.sparkContext.broadcast((pieces, logp, h, c, total, distinct, n_docs, ends, types, mass))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logp, h, c, total, distinct, n_docs, ends, types, mass = cast.value
        lattice = Lattice(pieces, logp)
        known = np.full(len(h), np.nan)  # spellings of frequent words, summed when first met
        base = lambda x: np.log10((x + 0.1) / (total + 0.1 * (distinct + 1)))
        for batch in batches:
            uid = batch.column(0).to_numpy()
            for first, last, back, begin, words, hashes, _ in _spelled(batch.column(2)):
                at = np.minimum(np.searchsorted(h, hashes), max(len(h) - 1, 0))
                frequent = h[at] == hashes if len(h) else np.zeros(len(hashes), bool)
                values = np.zeros(len(words))
                values[frequent] = known[at[frequent]]
                todo = np.flatnonzero(np.isnan(values) | ~frequent)
                values[todo] = lattice.score([words[i].decode("utf-8", "replace") for i in todo])
                known[at[frequent]] = values[frequent]
                times = np.where(frequent, c[at], 0) if len(h) else np.zeros(len(words), np.int64)
                docs_of = np.repeat(np.arange(last - first), np.diff(begin))
                m = last - first
                add = lambda x: np.bincount(docs_of, x[back], m)  # noqa: E731, B023
                n_tokens = np.diff(begin) + 1
                n_known = add(frequent.astype(float)).astype(np.int64) + (n_docs > 0)
                base_score = add(np.where(frequent, base(times), 0.0)) + base(n_docs)
                whole = np.log10((np.where(frequent, times, 1) + types * np.exp(values)) / mass)
                full = add(np.where(frequent, whole, 0.0)) + np.log10(ends / mass)
                names = ["key", "uid", "doc_id", "tf", "spelled", "n_tokens", "n_known", "base_score", "score"]
                ids = uid[first:last]
                yield pa.RecordBatch.from_arrays([pa.array(core.mix(ids.view(np.uint64)).view(np.int64)), pa.array(ids), batch.column(1).slice(first, m), pa.array(np.zeros(m, np.int64)), pa.nulls(m, pa.float64()), pa.array(n_tokens), pa.array(n_known), pa.array(base_score), pa.array(full)], names)
                rare = ~frequent[back]
                pair, tf = np.unique(docs_of[rare] * len(words) + back[rare], return_counts=True)
                k = len(pair)
                if k:
                    d, w = np.divmod(pair, len(words))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[w].view(np.int64)), pa.array(ids[d]), pa.nulls(k, pa.int64()), pa.array(tf), pa.array(values[w]), *[pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]], names)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "key long, uid long, doc_id long, tf long, spelled double, n_tokens long, n_known long, base_score double, score double")
    rare = counts.where(rank < least).select(F.col("h").alias("key"), "c")
    joined = rows.join(rare.hint("merge"), "key", "left")
    c = F.coalesce("c", F.lit(0))
    tail = F.when(F.col("tf") > 0, F.col("tf") * F.log10((c + 0.1) / (total + 0.1 * (distinct + 1))))
    spelled = F.when(c > 0, F.log10((c + types * F.exp("spelled")) / mass)).otherwise((F.col("spelled") + float(np.log(types / mass))) / float(np.log(10)))
    by = joined.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.coalesce(F.sum(F.when((F.col("tf") > 0) & (c > 0), F.col("tf"))), F.lit(0))).alias("n_known"),
        (F.sum("base_score") + F.coalesce(F.sum(tail), F.lit(0.0))).alias("base_score"),
        (F.sum("score") + F.coalesce(F.sum(F.when(F.col("tf") > 0, F.col("tf") * spelled)), F.lit(0.0))).alias("score"),
    )
    return by.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
