import random

import pytest
from pyspark.sql import functions as F

from harrow.llm import mixing, oracle

from .brute import words


def docs(seed=2, n=400):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 50, 300]))), rng.choice(["b", "a", "a", "é", None, "c"])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", None), (3, rows[3][1], rows[3][2]), (None, "x y", "b")]


def wanted(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    lo, hi = 0.0, 1e9  # the rate at which capped shares add up
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(2 * size[s], mid * weight[s]) for s in order) < 1.5 * sum(size.values()):
            lo = mid
        else:
            hi = mid
    return size, {s: min(2 * size[s], lo * weight[s]) for s in order}


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return mixing.mix(df, F.array("source"), mixing.size_of(), own=F.col("source"))


def test_mix(spark):
    rows = docs()
    out = mixed(spark, rows).collect()
    size, target = wanted(rows)
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert r["size"] == len(words(r.text)) and 0 <= r.taken <= 2 * r["size"]
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-6)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 2, s
    again = mixed(spark, rows).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, size int, taken int, target int")
    out = mixing.mix(df, F.array("source"), mixing.size_of(), own=F.col("source"))
    assert out.count() == 0 and {"size", "taken", "target"} <= set(out.columns)


def test_route_overlapping():
    patterns = {("a",): [100, 100], ("b",): [10, 10], ("a", "b"): [50, 50]}
    flow = mixing.route(patterns, {"a": 60, "b": 90})
    assert sum(f["a"] for f in flow.values() if "a" in f) == 60 and sum(f["b"] for f in flow.values() if "b" in f) == 90
    # first uses only could give 160 words; 150 are wanted, and b reaches 90 only by repeating
    assert sum(max(0, sum(flow[p].values()) - c[0]) for p, c in patterns.items()) == 30


def cost(patterns, flow):
    return sum(sum(k * min(max(0, sum(flow[p].values()) - sum(c[:k])), c[k]) for k in range(len(c))) for p, c in patterns.items())


def best(patterns, quotas, most):
    """(words, -cost) of the best of all flows."""
    arcs = [(p, s) for p in patterns for s in p]

    def tries(i, flow, room):
        if i == len(arcs):
            yield sum(sum(f.values()) for f in flow.values()), -cost(patterns, flow)
            return
        p, s = arcs[i]
        for x in range(min(most.get((p, s), 0), room[s], sum(patterns[p]) - sum(flow[p].values())) + 1):
            yield from tries(i + 1, flow | {p: flow[p] | {s: x}}, room | {s: room[s] - x})

    return max(tries(0, {p: dict.fromkeys(p, 0) for p in patterns}, quotas))


def test_route_costs_least():
    rng = random.Random(3)
    for _ in range(150):
        patterns = {p: [n := rng.randint(0, 3), n, rng.randint(0, 2)] for p in rng.sample([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")], 3)}
        quotas = {s: rng.randint(0, 4) for s in "abc"}
        most = {(p, s): rng.randint(0, 4) for p in patterns for s in p}
        flow = mixing.route(patterns, quotas, most)
        for s in quotas:
            assert sum(f.get(s, 0) for f in flow.values()) <= quotas[s]
        assert all(0 <= x <= most[p, s] for p, f in flow.items() for s, x in f.items())
        assert (sum(sum(f.values()) for f in flow.values()), -cost(patterns, flow)) == best(patterns, quotas, most), (patterns, quotas, most)


def shared(seed=6, n=300):
    """Texts that several sources hold, some of them several times."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = f"t{i} " * rng.randint(1, 40)
        for s in rng.sample(["a", "b", "c", None], rng.choice([1, 1, 2, 3])) * rng.choice([1, 1, 1, 3]):
            rows.append((len(rows), text, s))
    return rows


def test_sources_with_common_texts(spark):
    rows = shared()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_copies(df, mixing.size_of(), F.xxhash64("text")).collect()
    size, target = wanted(rows)
    assert len(out) == len(rows)
    for s in size:
        mine = [r for r in out if r.source == s]
        assert all(0 <= r.taken <= 2 * r["size"] and r.source_size == size[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 12
    # texts repeat less than when each source picks by itself
    alone = mixing.mix(df, F.array("source"), mixing.size_of(), own=F.col("source")).collect()

    def repeats(rows):
        used, once = {}, {}
        for r in rows:
            used[r.text], once[r.text] = used.get(r.text, 0) + r.taken, r["size"]
        return sum(max(0, n - once[t]) for t, n in used.items())

    assert repeats(out) < repeats(alone)


def test_many_patterns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 8)
    rows = shared()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_copies(df, mixing.size_of(), F.xxhash64("text")).collect()
    size, target = wanted(rows)
    for s in size:
        assert abs(sum(r.taken for r in out if r.source == s) - target[s]) <= 12


def test_overlapping_documents(spark):
    rows = [(i, "w " * (i % 7 + 1), ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", None] if i % 2 else [] if i % 5 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    out = mixing.mix(df, F.col("sources"), mixing.size_of(), share=1.0).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in out)
    assert mixing.copies(mixing.mix(df, F.col("sources"), mixing.size_of())).columns == df.columns


def test_sizes_and_targets_in_sql(spark):
    """On the given table; SQL orders by bytes, as code points do in UTF-8."""
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from read_parquet('/root/testdata/sf0.01/documents.parquet')")
    want = {s: (n, t) for s, n, t in con.sql(oracle.SOURCES + " select source, size, least(cap, rate * weight) as target from o cross join r").fetchall()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    got = mixing.mix_copies(docs, mixing.size_of(), F.xxhash64("text")).groupBy("source").agg(F.max("source_size").alias("n"), F.max("target").alias("t"), F.sum("size").alias("m"), F.sum("taken").alias("taken")).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.n == r.m == want[r.source][0] and r.t == pytest.approx(want[r.source][1], rel=1e-9)
        assert abs(r.taken - r.t) <= 0.001 * r.t + 40, r


def least(rng, bounded):
    """Patterns of which many sources share few, with quotas that need ways through other patterns."""
    patterns, most = {}, {}
    for _ in range(14):
        p = tuple(sorted(rng.sample("abcd", rng.randint(1, 3))))
        n = rng.randint(1, 9)
        patterns[p] = [n, n, rng.randint(0, 6)]
        most |= {(p, s): rng.randint(0, 12) if bounded else 1 << 62 for s in p}
    return patterns, {s: rng.randint(5, 60) for s in "abcd"}, most


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_route_table_costs_least(spark, monkeypatch, seed):
    """Flows that stay in Spark move as many words at the same cost as those of the driver."""
    monkeypatch.setattr(mixing, "GROUP", 3)
    patterns, quotas, most = least(random.Random(seed), seed % 2 == 1)
    want = mixing.route(patterns, quotas, most)
    rows = [("".join(p), c, {s: most[p, s] for s in p}) for p, c in patterns.items()]
    df = spark.createDataFrame(rows, "_p string, costs array<long>, left map<string,long>")
    got = {p: dict.fromkeys(p, 0) for p in patterns}
    for r in mixing.route_table(df, quotas).collect():
        got[tuple(r._p)][r._s] = r.words
    assert all(0 <= x <= most[p, s] for p, f in got.items() for s, x in f.items())
    assert all(sum(f.values()) <= sum(patterns[p]) for p, f in got.items())
    moved = lambda flow: {s: sum(f.get(s, 0) for f in flow.values()) for s in quotas}
    assert all(moved(got)[s] <= quotas[s] for s in quotas)
    assert sum(moved(got).values()) == sum(moved(want).values()) and cost(patterns, got) == cost(patterns, want)


def test_many_patterns_keep_their_sources(spark, monkeypatch):
    """Beyond the driver's bound no document loses a source: a leaves the texts that it shares to b."""
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 1)
    texts = [(f"t{i} " * 10, s) for i in range(80) for s in (["a", "b"] if i % 2 else ["a"])]
    df = spark.createDataFrame([(k, t, s) for k, (t, ss) in enumerate(texts) for s in ss], "doc_id long, text string, source string")
    out = mixing.mix_copies(df, mixing.size_of(), F.xxhash64("text"), share=0.5).collect()
    used = {}
    for r in out:
        used[r.text] = used.get(r.text, 0) + r.taken
    # a few texts meet where one share ends and the next begins, as that is placed by hashes, not words
    assert sum(used.values()) == 600 and sum(max(0, n - 10) for n in used.values()) <= 50


def test_route_table_goes_through_other_sources(spark):
    """a and b first take what c could be reached by, and make way."""
    any_ = lambda p: dict.fromkeys(p, 1 << 62)
    rows = [("1", [10], any_("ab")), ("2", [10], any_("bc")), ("3", [10], any_("a"))]
    df = spark.createDataFrame(rows, "_p string, costs array<long>, left map<string,long>")
    got = {(r._p, r._s): r.words for r in mixing.route_table(df, dict.fromkeys("abc", 10)).collect() if r.words}
    assert got == {("3", "a"): 10, ("1", "b"): 10, ("2", "c"): 10}
