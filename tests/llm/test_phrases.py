import pickle
import random
import re
import tracemalloc
from collections import Counter

import numpy as np

from harrow.llm import phrases

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, least, best):
    f, n, out = {}, Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        c = f.setdefault(lang, Counter())
        for w in pieces_of(text):
            n[lang] += len(w)
            c.update(tuple(w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * c[p[i : i + m]]}
        found = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:best])]
    return sorted(out)


def texts(rng, n):
    words = "the The cat sat on a mat and it was New York city state of Éire ß 漢 x1 don't".split()
    seps = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!?", "\r\n", "-", "\x0b"]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60)))
        out.append((t, rng.choice(["en", "en", "en", "fr", None, "und", ""])))
    return [*out, ("", "en"), (None, "en"), (None, None), ("...", "zz"), ("word", "one"), ("new york " * 50, "en"), ("a" * 70000 + " b", "en")]


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    return sorted(map(tuple, phrases.collocations(df, **more).select(*COLUMNS).collect()))


def test_equals_brute_force(spark):
    rows = texts(random.Random(1), 300)
    want = brute(rows, 5, 40)
    assert got(spark, rows, least=5, best=40) == want and len(want) > 80


def test_tiles_heads_and_salts_change_nothing(spark, monkeypatch):
    """Tiny tiles and buffers, and all but seven words and phrases without a rank."""
    for name, value in (("SIDE", 3), ("DENSE", 2), ("TILES", 2), ("BUFFER", 10), ("HELD", 40)):
        monkeypatch.setattr(phrases, name, value)
    rows = texts(random.Random(2), 120)
    assert got(spark, rows, least=3, best=25, head=7, salts=3) == brute(rows, 3, 25)
    assert got(spark, rows, least=3, best=25) == brute(rows, 3, 25)
    assert got(spark, rows, least=3, best=25, head=0) == brute(rows, 3, 25)


def test_tiles_count_exactly():
    rng = np.random.default_rng(4)
    names = np.arange(1000, 1400)
    ranks = phrases.Ranks(names, np.arange(400)[::-1], True)
    cells, want = phrases.Cells(ranks), Counter()
    for _ in range(5):
        rank = np.minimum(rng.geometric(0.05, 50000), 400) - 1
        cells.add(rank, ranks.by_rank[rank], np.ones(len(rank) - 1, bool))
        want.update(zip(ranks.by_rank[rank[:-1]].tolist(), ranks.by_rank[rank[1:]].tolist(), strict=True))
    cells.count()
    assert cells.tiles  # the dense form was used
    rows = [r for b in cells.rows() for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert {(x, y): n for x, y, n in rows} == want and len(rows) == len(want)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "text string, lang string, n int, name string, score int")
    assert phrases.collocations(df).count() == 0
    df = spark.createDataFrame([("big data, big data", None, 1, "x", 2)] * 20, "text string, lang string, n int, name string, score int")
    assert [tuple(r) for r in phrases.collocations(df).collect()] == [("und", 1, "big data", 40, 40, 40, 80, 1000000)]


def test_a_worker_holds_few_bytes_a_name():
    rng = np.random.default_rng(5)
    names, n = rng.integers(-(1 << 63), 1 << 63, 200_000), rng.zipf(1.3, 200_000)
    ranks = phrases.Ranks(names, n, True)
    assert len(pickle.dumps(ranks, pickle.HIGHEST_PROTOCOL)) < 13 * len(names)
    others = rng.integers(-(1 << 63), 1 << 63, 100_000)
    assert (ranks.by_rank[ranks.look(names)] == names).all() and (ranks.look(others) == phrases.NAMED).all()


def test_counting_holds_a_bounded_part_of_the_cells():
    """Neighbours of little in common: the memory beside what the ranks take, with rows handed on as they come."""
    rng = np.random.default_rng(6)
    ranks = phrases.Ranks(rng.integers(-(1 << 63), 1 << 63, 300_000), np.ones(300_000, np.int64), True)
    tracemalloc.start()
    cells, n = phrases.Cells(ranks), 0
    for _ in range(48):
        rank = rng.integers(0, 300_000, 100_001)
        cells.add(rank, ranks.by_rank[rank], np.ones(100_000, bool))
        if cells.full():
            n += sum(sum(b.column(2).to_pylist()) for b in cells.rows())
    n += sum(sum(b.column(2).to_pylist()) for b in cells.rows())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4_800_000 and peak < 70e6


def test_a_row_of_pieces_is_small(spark):
    """A long text goes in rows of some KB, as batches of them are what a task holds; none of its words is lost."""
    df = spark.createDataFrame([("big data and more, " * 60_000, "en")], "text string, lang string").coalesce(1)
    counted = phrases.word_counts(df).where("n > 1").select("name", "n")
    rows = phrases._pieces(df, phrases._ranks(counted, 100), "text", "lang").selectExpr("length(ranks) n").toPandas().n
    assert rows.sum() == 60_000 * 5 * 4 and rows.max() < 100_000
