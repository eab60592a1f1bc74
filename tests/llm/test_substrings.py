import random

import numpy as np

from harrow.llm import core, substrings

from .brute import repeats, words


def corpus(seed=4):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["a", "b", "é"]
    passage = [[rng.choice(vocab) for _ in range(rng.choice([49, 50, 51, 60, 120]))] for _ in range(12)]
    rows = []
    for i in range(160):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.choice(passage)
            a = rng.randint(0, 3)
            at = rng.randint(0, len(w))
            w[at:at] = p[a:]
        rows.append((i * 3 % 1000, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(2000 + i, rows[i][1]) for i in range(0, 40, 4)]
    rows += [(3000, "x " * 300), (3001, "x " * 120), (3002, "y " + "x " * 49), (3003, "a b " * 100), (3004, "b a " * 70), (3005, "a b c " * 60)]
    rows += [(4000, None), (4001, ""), (4002, " \n"), (None, rows[0][1]), (-5, rows[1][1])]
    return rows


def check(got, rows):
    want = repeats(rows)
    assert len(got) == len(rows)
    for r in got:
        n, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept) == (n, n - len(kept), " ".join(kept)), r.doc_id


def test_against_all_windows(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(substrings.remove_repeats(df).collect(), rows)


def test_small_chunks(spark, monkeypatch):
    """With one document a chunk nothing is settled locally."""
    rows = corpus(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    monkeypatch.setattr(core, "BATCH_ROWS", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(substrings.remove_repeats(df).collect(), rows)


def test_every_window_picks_by_its_content():
    rng = np.random.default_rng(0)
    words_ = rng.integers(1, 40, 5000).astype(np.uint64)
    part = words_[1000:1300]
    name, d, a, b = substrings.picks(core.mix(np.concatenate([words_, part])), np.array([0, 5000, 5300]))
    by = {}
    for n, doc, lo, hi in zip(name.tolist(), d, a, b, strict=True):
        for i in range(lo, hi + 1):
            by.setdefault((doc, i), set()).add(n)
    assert all((0, i) in by for i in range(4951)) and all((1, i) in by for i in range(251))
    assert all(by[1, i] & by[0, 1000 + i] for i in range(251))


def test_repeated_rows_and_empty(spark):
    rows = [(1, "p " * 60), (1, "p " * 60), (2, "q " + "p " * 55)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, 55)]
    assert substrings.digests(df.limit(0)).count() == 0


def test_words_of_pieces():
    text = ("a" * 200_000 + " b  c\x1cd é ") * 2 + "z" * 70_000
    raw = np.frombuffer(text.encode(), np.uint8)
    h, begin = core.word_hashes(raw, np.array([0, len(raw)]))
    w = words(text)
    assert len(h) == len(w) and len(set(h.tolist())) == len(set(w)) and begin.tolist() == [0, len(w)]
    one = [core.word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0][0] for x in w]
    assert one == h.tolist()


def test_a_doc_id_with_several_texts(spark):
    """Each row is judged by its own words; what occurs nowhere else stays."""
    rng = random.Random(3)
    a, b, c = ([f"{x}{rng.randint(0, 10**9)}" for _ in range(60)] for x in "abc")
    rows = [(1, a), (5, a), (5, b), (6, b[:55] + c), (7, c + a), (7, b), (9, c[5:])]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string")
    want = {(1, a[0]): a, (5, a[0]): [], (5, b[0]): b, (6, b[0]): c, (7, c[0]): [], (7, b[0]): [], (9, c[5]): []}
    got = substrings.remove_repeats(df).collect()
    assert sorted((r.doc_id, r.n_words - r.n_removed, r.kept) for r in got) == sorted((d, len(w), " ".join(w)) for (d, _), w in want.items())


def test_one_row_a_key_and_chunk():
    """A line that a text repeats very often, and a passage of all texts, send few rows."""
    import pyarrow as pa

    line, passage = "l " * 20000, " ".join(f"p{i}" for i in range(80))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([line, passage + " x", passage + " y"])], ["doc_id", "text"])
    more = pa.RecordBatch.from_arrays([pa.array([4, 5]), pa.array([passage, line])], ["doc_id", "text"])
    rows = pa.Table.from_batches(list(substrings._shared_symbols(iter([batch, more]))))
    open_ = rows.filter(rows.column("tag").is_valid()).column("key").to_pylist()
    assert len(open_) <= len(set(open_)) + 40 and len(open_) < 400
