import numpy as np
from pyspark.sql import functions as F

from harrow.llm import embeddings

from .brute import components


def brute(rows):
    links, n = [], {}
    for i, (v, e, lab) in enumerate(rows):
        n[v] = 0
    ok = [(v, np.array(e, float), lab) for v, e, lab in rows if lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    for i, (v, x, a) in enumerate(ok):
        for w, y, b in ok[i + 1 :]:
            if a == b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links.append((v, w))
                n[v] += 1
                n[w] += 1
    comp = components(n, links)
    return {(v, n[v], comp[v], comp[v] == v) for v in n}


def data(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(300):
        base = rng.standard_normal(16) * 10.0 ** rng.integers(-3, 3)
        rows.append((len(rows), [float(np.float32(x)) for x in base], int(rng.integers(0, 3))))
        for _ in range(int(rng.choice([0, 0, 1, 5]))):
            near = base + rng.standard_normal(16) * np.abs(base).mean() * rng.choice([0, 0.05, 0.15, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in near], rows[-1][2]))
    k = len(rows)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] * 16, [inf] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8]
    rows += [(k + i, e, 1) for i, e in enumerate(odd)] + [(k + 20, rows[0][1], None)]
    return rows


def test_against_all_pairs(spark):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {tuple(r) for r in embeddings.near_duplicates(df).collect()}
    assert got == brute(rows)
    split = {tuple(r) for r in embeddings.near_duplicates(df.withColumn("kept", F.lit(1)), block=8).collect()}
    assert split == got


def test_large_group_and_empty(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(i, (base + rng.standard_normal(16) * 0.01).tolist() if i % 2 else base.tolist(), 0) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(df, block=100).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(599, 0)}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, [1.0, 2.0], 0), (5, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, embeddings.near_duplicates(none).collect()), key=str) == sorted([(None, 0, None, False), (5, 0, 5, True)], key=str)


def test_extreme_magnitudes_and_design(spark):
    rows = [(0, [1e-200, 2e-200], 0), (1, [1e200, 2e200], 0), (2, [5e-324, 1e-323], 0), (3, [1.0, 2.0], 0), (4, [2.0, -1.0], 0), (5, [1e300, 1e-300], 1), (6, [1.0, 0.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4), 5: (1, 5), 6: (1, 5)}
    agree = 1 - np.arccos(0.98) / np.pi
    for n in (0, 1, 10**4, 10**9):
        tables, bits = embeddings.design(n)
        assert (1 - agree**bits) ** tables <= embeddings.MISS and 2**bits >= 8 * n


def test_recall_on_the_given_table(spark):
    """All pairs of the table in double precision, by label."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, None if r.embedding is None else list(r.embedding), r.label) for r in e.collect()]
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(e).collect()}
    want = {v: n for v, n, _, _ in brute(rows)}
    assert sum(got.values()) >= 0.999 * sum(want.values()) and all(got[v] <= want[v] for v in want)
