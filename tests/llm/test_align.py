import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from harrow.llm import align
from harrow.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTES, PIECES = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
BYTES.encode_special_tokens = True
ODD = ["", None, "a", " ", "  a  b", "x<|endoftext|>y <s>", "▁a", "a▁b", "漢字 😀 é", "a" * 500, " " * 1500 + "x", "x" + "\n" * 1200, "the cat sat", "the cat sat", "İ ﬁ ½"]


def byte_tokens(text):
    of = {c: b for b, c in enumerate(byte_letters())}
    ids = BYTES.encode(" " + text, add_special_tokens=False).ids
    return ids, [bytes(of[c] for c in BYTES.id_to_token(i)) for i in ids]


def piece_tokens(text):
    ids = PIECES.encode(text)
    return ids, [bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode() for i in ids]


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(rows):
    """Links by comparing all tokens of a text with all others."""
    found = []
    for key, text in rows:
        (a, ta), (b, tb) = (byte_tokens(text), piece_tokens(text)) if text else (([], []), ([], []))
        if b"".join(ta) != b" " + (text or "").encode() or b"".join(tb) != b"".join(ta):
            a, b, ta, tb = [], [], [], []
        sa, sb = spans(ta), spans(tb)
        links = [(i, j) for (i, (p, q)), (j, (r, s)) in ((x, y) for x in zip(a, sa) for y in zip(b, sb)) if p < s and r < q]
        ends = sorted({q for _, q in sa} & {q for _, q in sb})
        groups, low = [], 0
        for high in ends:
            groups.append(",".join(str(i) for i, (p, q) in zip(a, sa) if low <= p and q <= high) + "|" + ",".join(str(j) for j, (p, q) in zip(b, sb) if low <= p and q <= high))
            low = high
        found.append((key, a, b, groups, links))
    count = Counter(x for *_, links in found for x in links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return [(k, len(a), len(b), len(g), len(x), sum(count[y] == best[y[1]] for y in x), sum(count[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for k, a, b, g, x in found]


def rows_of(rng, n):
    letters = "abcdeé '’.,!?-012\n\t<|>Σ漢😀▁\x00 etaoinshr   "
    words = "the cat sat on a mat and it was very happy about uncommonly large hats".split()
    out = list(enumerate(ODD))
    out += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(n)]
    return out + [(1000 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 60)))) for i in range(n)] + [(None, "the cat"), (1000, "again the cat")]


def test_equals_brute_force(spark):
    rows = rows_of(random.Random(1), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, align.digests(df, A, B).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_bands_and_trees_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(align, "SHARD", 64)
    monkeypatch.setattr(align, "FAN", 2)
    monkeypatch.setattr(align, "BLOCK", 128)
    monkeypatch.setattr(align, "HELD", 50)
    rows = rows_of(random.Random(2), 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = align.align(df, A, B, most=40)
    assert sorted(map(tuple, out.select("doc_id", *align.MEASURES).collect()), key=str) == sorted([r[:7] for r in brute(rows)], key=str)


def test_numbers_are_minimal_and_perfect():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 31, 20000))
    shards = []
    for s in range(3):
        own = keys[align._shard(keys, 3) == s]
        sizes, words, order = align.build(own)
        shards.append((s, sizes, words.tobytes(), order.tobytes()))
    h = align.PairHash(shards, 3)
    assert sorted(h.numbers(keys).tolist()) == list(range(len(keys)))
    absent = np.setdiff1d(rng.integers(0, 1 << 31, 1000), keys)
    for k in absent[:50]:
        try:
            h.numbers(np.array([k]))
        except RuntimeError:
            continue
        raise AssertionError("an absent pair got a number")


def test_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string, a int, n_best string, groups int")
    out = align.align(df, A, B)
    assert out.columns == ["doc_id", "a", "b", *align.MEASURES, "groups"] and out.count() == 0
    df = spark.createDataFrame([(1, None, "x")], "doc_id long, text string, other string")
    assert [tuple(r) for r in align.align(df, A, B).drop("a", "b").collect()] == [(1, "x", 0, 0, 0, 0, 0, 0, "")]
