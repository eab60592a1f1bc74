"""Phrases of two to four words that belong together, per language.

Words with at least `least` occurrences are ranked by frequency, over all languages; texts become rows of
ranks once. Neighbours are then counted in tiles of the (left rank, right rank) plane: a tile with many
hits in a task is a dense table, filled at its direct address, the others are sorted coordinates. The
tasks' cells are summed by one grouping. Pairs with enough occurrences are ranked anew, and
the same count over neighbouring pairs gives the triples, over neighbouring triples the phrases of four: a
phrase is frequent only if both phrases that it overlaps in all but one word are.

Words and phrases are named by 64 bits of hash; the ranks are only addresses. At most `head` of them have a
rank (sent to all workers); what has none goes by its name through the same coordinates, so nothing is left out.
A worker holds 8 bytes and some bits a name, for the words and for the phrases that are ranked last; of those
between it holds only the bits, which may let a rare phrase pass, to be counted and then found too rare.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows count each;
other columns are ignored. No phrase with enough occurrences in a language: no row of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import core

#: Phrases (words at first) with a rank: each takes 8 bytes, and 16 to 32 bits, in every worker.
HEAD = 2_000_000
#: Side of a tile; hits in a task's buffer from which a tile is dense; dense tiles of a task (1 MB each), and
#: hits that they hold before they are handed on, so that no count passes 32 bits.
SIDE, DENSE, TILES, TILED = 512, 1 << 13, 24, 1 << 30
#: Neighbours that a task counts at once, and cells that it holds before it hands them on.
BUFFER, HELD = 1 << 19, 1 << 19
#: Ranks and breaks of a row of pieces, about (a longer piece is a row of its own), and bytes that a task takes up at once.
LINE, STRETCH = 1 << 10, 1 << 19
#: Ranks at which the names begin anew in order: what is frequent is looked up among few.
STEPS = (1 << 9, 1 << 12, 1 << 15, 1 << 18)
#: Rows of a batch that a task hands on; different words that it holds.
ROWS, WORDS = 1 << 17, 150_000
#: Parts into which each language is dealt before its best phrases are chosen.
SALTS = 64
#: Before a piece; a word or phrase without a rank.
BREAK, NAMED = -1, -2

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(10, 14)]] = True
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _words(raw: np.ndarray, at: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the words of documents: document, begin, end, whether a piece begins with it, and its name (by its
    letters and the document's salt)."""
    gap = _BLANK[raw] | _STOP[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    begins = np.flatnonzero(~gap & (np.append(True, gap[:-1]) | cut[:-1]))
    ends = np.flatnonzero(~gap & (np.append(gap[1:], True) | cut[1:])) + 1
    doc = np.searchsorted(at, begins, "right") - 1
    piece = np.append(0, np.cumsum(_STOP[raw]))[begins] + doc
    hashes, _ = core.word_hashes(np.where(gap, np.uint8(32), raw), at)
    return doc, begins, ends, np.append(True, piece[1:] != piece[:-1])[: len(begins)], core.mix(hashes ^ salts[doc]).view(np.int64)


def _salt(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode(), np.uint8)
    with np.errstate(over="ignore"):
        h = np.uint64(len(raw) + 1) * _ODD
        for b in raw:
            h = (h ^ np.uint64(b)) * _ODD
            h ^= h >> np.uint64(31)
    return h


def _spelled(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Runs of documents: languages, language of each word, bytes, begins, ends, first of a piece, names."""
    raw_all, at_all = core.text_bytes(batch.column(batch.schema.get_field_index("text")))
    langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
    known = {x: i for i, x in enumerate(sorted(set(langs)))}
    number = np.array([known[x] for x in langs], np.int64)
    salts = np.array([_salt(x) for x in known], np.uint64)
    for i, j in core.chunks(at_all):
        raw = core.LOWER[raw_all[at_all[i] : at_all[j]]]
        if len(raw):
            doc, *words = _words(raw, at_all[i : j + 1] - at_all[i], salts[number[i:j]])
            yield [*known], number[i:j][doc], raw, *words


def _input(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """name, lang, word, n of all words."""
    core.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for known, of, raw, begins, ends, _, names in _spelled(batch):
                name, one, n = np.unique(names, return_index=True, return_counts=True)
                for k, i, c in zip(name.tolist(), one.tolist(), n.tolist(), strict=True):
                    if k in held:
                        held[k][3] += c
                    else:
                        held[k] = [k, known[of[i]], raw[begins[i] : ends[i]].tobytes().decode(), c]
                if len(held) > WORDS:
                    yield rows(held)
                    held = {}
        yield rows(held)

    def rows(held: dict[int, list]) -> pa.RecordBatch:
        name, lang, word, n = zip(*held.values(), strict=True) if held else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["name", "lang", "word", "n"])

    cells = _input(docs, text, lang).mapInArrow(run, "name long, lang string, word string, n long")
    return cells.groupBy("name", "lang", "word").agg(F.sum("n").alias("n"))


class Bits:
    """A set of names as bits: `may` holds for each of them, and for one in sixteen of others at most."""

    def __init__(self, names: np.ndarray):
        n = max(10, (16 * len(names)).bit_length())
        self.shift = np.uint64(64 - n)
        flags = np.zeros(1 << n, bool)
        flags[names.view(np.uint64) >> self.shift] = True
        self.bits = np.packbits(flags, bitorder="little")

    def may(self, names: np.ndarray) -> np.ndarray:
        at = (names.view(np.uint64) >> self.shift).view(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


class Ranks:
    """Names, the most frequent first: those between two of the STEPS are in the order of their names.
    `whole` says that no other name is frequent."""

    def __init__(self, names: np.ndarray, n: np.ndarray, whole: bool):
        self.by_rank = names[np.lexsort((names, -n))]
        self.steps = [0, *(k for k in STEPS if k < len(names)), len(names)]
        for a, b in zip(self.steps, self.steps[1:], strict=False):
            self.by_rank[a:b].sort()
        self.bits, self.whole = Bits(self.by_rank), whole

    def look(self, names: np.ndarray) -> np.ndarray:
        rank = np.full(len(names), NAMED, np.int64)
        at = np.flatnonzero(self.bits.may(names))
        for a, b in zip(self.steps, self.steps[1:], strict=False):
            if not len(at) or a == b:
                break
            part, wanted = self.by_rank[a:b], names[at]
            place = np.minimum(np.searchsorted(part, wanted), b - a - 1)
            hit = part[place] == wanted
            rank[at[hit]] = place[hit] + a
            at = at[~hit]
        return rank


def _ranks(counted: DataFrame, head: int):
    """The most frequent rows of (name, n), as a broadcast."""
    rank, least = core.most_frequent(counted, "n", head)
    got = counted.where(rank >= least).select("name", "n").toArrow()
    whole = counted.where(rank < least).isEmpty()
    return counted.sparkSession.sparkContext.broadcast(Ranks(got["name"].to_numpy(), got["n"].to_numpy(), whole))


def pair_name(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return core.mix(core.mix(left.view(np.uint64)) * _ODD + right.view(np.uint64)).view(np.int64)


class Cells:
    """Counts of (left, right) pairs of a task: dense tiles by direct address, coordinates for the rest."""

    def __init__(self, ranks: Ranks):
        self.ranks, self.tiles = ranks, {}
        self.across = len(ranks.by_rank) // SIDE + 1
        self.waiting: list[np.ndarray] = []
        self.coo: list[tuple[np.ndarray, np.ndarray]] = []
        self.named: list[tuple[np.ndarray, ...]] = []
        self.n_waiting = self.n_held = self.n_named = self.n_tiled = 0

    def add(self, rank: np.ndarray, name: np.ndarray, joined: np.ndarray) -> None:
        """Neighbours i, i+1 with joined[i]; a negative rank is a phrase without one, which has only its name."""
        i = np.flatnonzero(joined)
        left, right = rank[i], rank[i + 1]
        both = (left >= 0) & (right >= 0)
        if not both.all():
            if not self.ranks.whole:
                x, y = name[i[~both]], name[i[~both] + 1]
                self.named.append(_merged(pair_name(x, y), x, y, np.ones(len(x), np.int64)))
                self.n_named += len(self.named[-1][0])
            left, right = left[both], right[both]
        if len(left):
            # cells are numbered tile by tile
            tile = left // SIDE * self.across + right // SIDE
            self.waiting.append(tile * SIDE**2 + left % SIDE * SIDE + right % SIDE)
            self.n_waiting += len(left)
            if self.n_waiting > BUFFER:
                self.count()

    def count(self) -> None:
        if not self.waiting:
            return
        cell = np.concatenate(self.waiting)
        self.waiting, self.n_waiting = [], 0
        cell.sort()
        first, last = core.runs(cell)
        cell, n = cell[first], last - first
        tile = cell // SIDE**2
        begins, ends = core.runs(tile)
        hits, tile = np.add.reduceat(n, begins), tile[begins]
        sparse = np.ones(len(cell), bool)
        for k in np.flatnonzero((hits >= DENSE) | np.isin(tile, [*self.tiles])):
            t, i, j = int(tile[k]), begins[k], ends[k]
            if t not in self.tiles:
                if len(self.tiles) >= TILES:
                    continue
                self.tiles[t] = np.zeros(SIDE**2, np.int32)
            self.tiles[t][cell[i:j] - t * SIDE**2] += n[i:j].astype(np.int32)
            self.n_tiled += int(hits[k])
            sparse[i:j] = False
        self.coo.append((cell[sparse], n[sparse]))
        self.n_held += len(self.coo[-1][0])
        if len(self.coo) > 8:
            self._sum()

    def _sum(self) -> None:
        if len(self.coo) > 1:
            cell, n = (np.concatenate(x) for x in zip(*self.coo, strict=True))
            self.coo = []
            self.coo = [_merged(cell, n)]
            self.n_held = len(self.coo[0][0])

    def full(self) -> bool:
        if self.n_held + 2 * self.n_named <= HELD:
            return self.n_tiled > TILED
        self._sum()
        return self.n_held + 2 * self.n_named > HELD // 2 or self.n_tiled > TILED

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All cells so far as (left name, right name, n), a few at a time; starts anew."""
        self.count()
        self._sum()
        for cell, n in self.coo:
            for i in range(0, len(cell), ROWS):
                yield self._named(cell[i : i + ROWS], n[i : i + ROWS])
        self.coo = []
        for t in [*self.tiles]:
            table = self.tiles.pop(t)
            hit = np.flatnonzero(table)
            yield self._named(t * SIDE**2 + hit, table[hit].astype(np.int64))
        if self.named:
            _, x, y, n = _merged(*(np.concatenate(p) for p in zip(*self.named, strict=True)))
            self.named = []
            for i in range(0, len(x), ROWS):
                yield _cells(x[i : i + ROWS], y[i : i + ROWS], n[i : i + ROWS])
        self.n_held = self.n_named = self.n_tiled = 0

    def _named(self, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        (tile, at), by = np.divmod(cell, SIDE**2), self.ranks.by_rank
        return _cells(by[tile // self.across * SIDE + at // SIDE], by[tile % self.across * SIDE + at % SIDE], n)


def _merged(key: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row a key; the last column is summed."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first, _ = core.runs(key)
    *same, n = more
    n = np.add.reduceat(n[order], first) if len(first) else n
    return key[first], *(x[order[first]] for x in same), n


def _cells(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(n)], ["left", "right", "n"])


def _climb(rank: np.ndarray, name: np.ndarray, joined: np.ndarray, between: list[Bits | None], last: Ranks | None) -> tuple[np.ndarray, ...]:
    """From words to the phrases of `last`, one a place: rank, name, and whether the phrases at i and i + 1
    overlap in a phrase of one word more that may be frequent. joined says so of the words. `between` has the
    lengths between, without bits where phrases are frequent beside those that have a rank."""
    for known in [*between, last] if last else []:
        name, live = pair_name(name[:-1], name[1:]), joined.copy()
        at = np.flatnonzero(joined)
        if known is last:
            rank = np.full(len(name), NAMED)
            rank[at] = last.look(name[at])
            if last.whole:
                live = rank >= 0
        elif known:
            live[at] = known.may(name[at])
        joined = live[:-1] & live[1:]
    return rank, name, joined


def neighbours(rows: DataFrame, words, between: list, last, least: int) -> DataFrame:
    """left, right, n, name: how often the phrases that are ranked last overlap (words: touch), from `least` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, bits, ranks = words.value, [b and b.value for b in between], last and last.value
        cells = Cells(ranks or first)
        for batch in batches:
            (ranked, at), (unranked, of) = (core.text_bytes(c) for c in batch.columns)
            for i, j in core.chunks(at, STRETCH):
                signs = ranked[at[i] : at[j]].view(np.int32).astype(np.int64)
                rank = signs[signs != BREAK]
                begins = np.zeros(len(rank) + 1, bool)
                cuts = np.flatnonzero(signs == BREAK)
                begins[cuts - np.arange(len(cuts))] = True
                name = np.zeros(len(rank), np.int64)
                name[rank >= 0] = first.by_rank[rank[rank >= 0]]
                name[rank == NAMED] = unranked[of[i] : of[j]].view(np.int64)
                if len(rank) > len(bits) + 1 + bool(ranks):
                    cells.add(*_climb(rank, name, ~begins[1:-1], bits, ranks))
                if cells.full():
                    yield from cells.rows()
        yield from cells.rows()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = pair_name(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name)], ["left", "right", "n", "name"])

    cells = rows.mapInArrow(run, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))
    return cells.where(F.col("n") >= least).mapInArrow(named, "left long, right long, n long, name long")


def _lines(signs: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """Pieces as rows of about LINE signs, each with the names of its words without a rank."""
    breaks = np.flatnonzero(signs == BREAK)
    cuts = breaks[np.append(True, np.diff(breaks // LINE) > 0)[: len(breaks)]]
    of = np.searchsorted(np.flatnonzero(signs == NAMED), cuts)
    columns = [
        pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer((np.append(begins, len(x)) * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
        for x, begins in ((signs.astype(np.int32), cuts), (np.ascontiguousarray(names), of))
    ]
    return pa.RecordBatch.from_arrays(columns, ["ranks", "names"])


def _pieces(docs: DataFrame, ranks, text: str, lang: str) -> DataFrame:
    """Texts as `ranks` (32 bits each) of their words, with BREAK before each piece, and NAMED for a word
    without a rank, whose name (64 bits) is in `names`. Words that cannot be in a phrase only part pieces.
    A row holds whole pieces of one text or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranks.value
        for batch in batches:
            for *_, first, name in _spelled(batch):
                rank = known.look(name)
                if known.whole:
                    keep = rank >= 0
                    part = np.cumsum(first | ~keep | np.append(True, ~keep[:-1])[: len(keep)])[keep]
                    rank, name, first = rank[keep], name[keep], np.append(True, part[1:] != part[:-1])[: len(part)]
                yield _lines(np.insert(rank, np.flatnonzero(first), BREAK), name[rank == NAMED])

    return _input(docs, text, lang).mapInArrow(run, "ranks binary, names binary")


#: Score and counts of the lowest-scoring cut of a phrase, exact beyond 64 bits.
_CUT = """array_min(transform(sequence(1, size(words) - 1), k -> named_struct(
  'score', cast(a as decimal(20,0)) * 2000000 div (cast(starts[k - 1] as decimal(20,0)) + rests[size(words) - k - 1]), 'k', k, 'l', starts[k - 1], 'r', rests[size(words) - k - 1])))"""


def collocations(docs: DataFrame, least: int = 30, best: int = 2000, text: str = "text", lang: str = "lang", head: int = HEAD, salts: int = SALTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `best` of each language (see the module)."""
    words = core.cut(word_counts(docs, text, lang), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = [core.cut(words.where(F.col("n") >= least), "frequent")]
    ranked = _ranks(frequent[0], head)
    rows = core.cut(_pieces(docs, ranked, text, lang), "pieces")
    between, last = [], None
    for length in (2, 3, 4):
        frequent.append(core.cut(neighbours(rows, ranked, between, last, least), "phrases"))
        if last:
            # shorter phrases are only passed through from here on
            between.append(docs.sparkSession.sparkContext.broadcast(last.value.bits) if last.value.whole else None)
            last.destroy()
        last = _ranks(frequent[-1], head) if length < 4 else None
    for sent in (ranked, *between):
        if sent:
            sent.destroy()
    core.drop_cut(rows)
    f1, f2, f3, f4 = frequent

    # what each phrase is made of, up from the words; starts[k] counts its first k + 1 words, rests[k] its last
    held, made = f1.select("name", "lang", F.array("word").alias("words"), F.array("n").alias("starts"), F.array("n").alias("rests")), []
    for f in (f2, f3, f4):
        x = held.select(F.col("name").alias("left"), "lang", F.col("words").alias("_w"), F.col("starts").alias("_s"))
        y = held.select(F.col("name").alias("right"), F.element_at("words", -1).alias("_last"), F.col("rests").alias("_r"))
        grown = [F.concat(first, F.array(last)).alias(c) for first, last, c in (("_w", "_last", "words"), ("_s", "n", "starts"), ("_r", "n", "rests"))]
        held = core.cut(f.join(x, "left").join(y, "right").select("name", "lang", "left", "right", "n", *grown), "made")
        made.append(held)
    left = []
    for held, longer in zip(made, [*made[1:], None], strict=True):
        if longer is not None:
            # if a phrase of two words more holds it often enough, so does one of one word more
            most = longer.select(F.explode(F.array("left", "right")).alias("name"), "n").groupBy("name").agg(F.max("n").alias("_most"))
            held = held.join(most, "name", "left").where("_most is null or cast(_most as decimal(20,0)) * 100 < cast(n as decimal(20,0)) * 80")
        left.append(held.select("lang", "words", F.col("n").alias("a"), "starts", "rests", "name"))
    every = left[0].unionAll(left[1]).unionAll(left[2]).withColumn("m", F.expr(_CUT))
    scored = every.select("lang", F.array_join("words", " ").alias("phrase"), "a", "m.l", "m.r", "m.score", F.pmod("name", F.lit(salts)).alias("_salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= best)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
