import random

from harrow.llm import jaccard

from .brute import components, shingles


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(3000)]
    common = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 20, 60, 200]))]
        if rng.random() < 0.4:
            w[3:3] = common
        rows.append((len(rows), w))
        for _ in range(rng.choice([0, 0, 1, 4])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                k = rng.randrange(len(v) + 1)
                if rng.random() < 0.5 and len(v) > 1:
                    del v[min(k, len(v) - 1)]
                else:
                    v[k:k] = [rng.choice(vocab)]
            rows.append((len(rows), v))
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(x.upper() if rng.random() < 0.1 else x for x in w)) for i, w in rows]
    k = len(rows)
    return rows + [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "É a"), (k + 4, "é a"), (-7, rows[0][1]), (None, rows[0][1])]


def brute(rows):
    s = {d: shingles(t) for d, t in rows if d is not None}
    ids = [d for d in s if s[d]]
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 5 * min(len(s[a]), len(s[b])) >= 4 * max(len(s[a]), len(s[b])) and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    comp = components(s, links)
    return {(d, len(s[d]), comp[d]) for d in s}


def got(df):
    return {tuple(r)[:3] for r in jaccard.near_duplicates(df).collect() if r.doc_id is not None}


def test_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert len({c for *_, c in want}) < len(want)
    assert got(df) == want


def test_null_id_before_its_copy(spark):
    """One partition, the row without doc_id first: its class still has a bitmap."""
    words = ["w%d" % i for i in range(60)]
    text, near = " ".join(words), " ".join([*words, "x"])
    df = spark.createDataFrame([(None, text), (2, text), (1, near), (None, near), (3, near)], "doc_id long, text string").coalesce(1)
    assert got(df) == {(2, 56, 1), (1, 57, 1), (3, 57, 1)}
    assert jaccard.near_duplicates(df).count() == 5


def test_frequent_shingles_and_grids(spark, monkeypatch):
    """Large groups of near copies, frequent shingles last, blocks of groups and clusters."""
    rng = random.Random(1)
    base = ["b%d" % i for i in range(100)]
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(100)] = "x%d" % rng.randrange(10**6)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, t) for i, t in corpus(7) if i is not None]
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 50)
    monkeypatch.setattr(jaccard, "CELL_TOKENS", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_shingles int")
    assert jaccard.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in jaccard.near_duplicates(one).collect()] == [(1, 1, 1)]


def test_a_large_group_leaves_as_a_grid():
    """Every pair of classes of a group meets in some part of it, and no part is much larger than two blocks."""
    import pyarrow as pa

    n = 500
    batch = pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array(list(range(n))), pa.array([60] * n)], ["cell", "cid", "n"])
    parts = {}
    for b in jaccard._groups(iter([batch]), block=100):
        for g, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parts.setdefault(g, set()).add(c)
    assert len(parts) == 15 and max(map(len, parts.values())) <= 300
    met = set()
    for p in parts.values():
        met |= {(a, b) for a in p for b in p if a < b}
    assert len(met) == n * (n - 1) // 2


def test_chains_across_cells(spark, monkeypatch):
    """Clusters dealt to blocks of few sets each; a doc_id with several texts."""
    monkeypatch.setattr(jaccard, "CELL_TOKENS", 200)
    rows, words = [], [f"w{i}" for i in range(400)]
    for c in range(4):
        for i in range(12):  # each links with its neighbours only
            rows.append((len(rows), " ".join(f"c{c}{w}" for w in words[i * 6 : i * 6 + 60])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len({c for *_, c in want}) == 4 and got(df) == want
    text, other = " ".join(words[:60]), " ".join(words[100:160])
    mixed = spark.createDataFrame([(1, text), (3, text + " x"), (3, other), (5, other + " y"), (0, other + " z q")], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(mixed).collect()} == {(1, 56, 1), (3, 57, 1), (3, 56, 0), (5, 57, 0), (0, 58, 0)}
