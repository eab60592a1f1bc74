import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from harrow.llm import lattice_lm
from harrow.llm.lattice_lm import MARK, Lattice

from .brute import words

PATH = public_tokenizers.path("piece_bpe_32k.model")


def fold(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]


def segmentations(word, pieces):
    if not word:
        yield ()
    for i in range(1, len(word) + 1):
        if word[:i] in pieces:
            for rest in segmentations(word[i:], pieces):
                yield (word[:i], *rest)


def test_forward_sums_all_segmentations():
    pieces = [MARK, MARK + "a", "a", "b", "ab", "ba", "aab", MARK + "ab", "é"]
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(len(pieces) + 257)))
    lattice = Lattice(pieces, logp)
    p = {x: math.exp(v) for x, v in zip(pieces, logp, strict=False)}
    todo = ["a", "ab", "aabab", "bab", "é", "aé", "a" * 12, "b"]
    for w, got in zip(todo, lattice.score(todo), strict=True):
        want = sum(math.prod(p[x] for x in seg) for seg in segmentations(MARK + w, p))
        assert got == pytest.approx(math.log(want), rel=1e-12)
    odd = lattice.score(["ж"])[0]
    assert odd == pytest.approx(logp[0] + logp[len(pieces) + 0xD0] + logp[len(pieces) + 0xB6])
    uses = lattice.expect(todo, np.ones(len(todo)))
    want = Counter()
    for w in todo:
        segs = {s: math.prod(p[x] for x in s) for s in segmentations(MARK + w, p)}
        for s, v in segs.items():
            for x in s:
                want[x] += v / sum(segs.values())
    assert uses[: len(pieces)] == pytest.approx([want[x] for x in pieces])


def corpus():
    rng = random.Random(1)
    vocab = ["The", "the", "of", "nderstionx", "Éa", "ж", "日本", "x" * 200, "a,b."] + ["w%d" % i for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocab[: rng.choice([9, 309])]) for _ in range(rng.randint(0, 40)))) for i in range(200)]
    return rows + [(900, None), (901, ""), (7, rows[7][1]), (None, "the of")]


def test_against_plain_counts(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = [r for h in (5, 1 << 18) for r in [lattice_lm.score(df, PATH, head=h).collect()]]
    train = Counter()
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0 if d is not None else True
    for d, t in rows:
        if not held(d):
            train.update([*fold(t), None])
    total, distinct = sum(train.values()), len(train)
    value = lambda w: math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1)))
    want = sorted(((d, held(d), len(fold(t)) + 1, sum(train[w] > 0 for w in [*fold(t), None]), total, round(sum(map(value, [*fold(t), None])), 6)) for d, t in rows), key=str)
    for got in out:
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    a, b = ({(r.doc_id, r.n_tokens): r.score for r in got} for got in out)
    assert a == pytest.approx(b)
    assert all(v < 0 for v in a.values()) and a[900, 1] == a[901, 1]
    assert a[None, 3] < a[900, 1]


def test_fitting_raises_held_out_likelihood(spark):
    rng = random.Random(2)
    syll = ["tion", "er", "an", "nd", "th", "ing", "sh"]
    rows = [(i, " ".join("".join(rng.choice(syll) for _ in range(rng.randint(1, 4))) for _ in range(50))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mean = lambda k: np.mean([r.score for r in lattice_lm.score(df, PATH, rounds=k).collect() if r.held_out])
    assert mean(1) > mean(0) + 10


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, score string")
    assert lattice_lm.score(df, PATH).count() == 0
    one = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    r = lattice_lm.score(one, PATH).first()
    assert (r.held_out, r.n_known, r.train_tokens) == (True, 0, 0) and math.isfinite(r.score)
