"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document may belong to several sources (`members`): those that hold its very text. Documents of one
set of sources form a pattern; only the patterns' sizes reach the driver. There, flow runs from the
patterns to the sources' quotas: the first use of a pattern's distinct texts costs 0, the second 1, any
further one 2 (convex), so a source draws first on what no other source has used, and repetition
starts only where first uses are gone. Where documents have an owner (`own`), a source draws on its own
rows alone, up to PASSES times their size, and so meets its quota; which patterns it draws on is the
flow's choice. Without owners a pattern serves any of its sources, up to PASSES times.

The flow is then dealt to documents: all of them for whole passes, and for the rest those that come
first by a seeded hash of their text, from where the pattern's source before stopped, so that sources
that share texts take different ones while they can. The last document gives just the words left.

Defined results: null texts have size 0; a null source is a source of its own, last in order;
documents of size 0 get 0; repeated rows are documents of their own, those at the edge share what is
left in proportion; an empty table gives no rows. All columns of the input stay; `size`, `taken`,
`source_size`, `target` replace columns of that name. More than MAX_PATTERNS rows of patterns and owners
stay in Spark: `route_table` finds a flow of the same words and the same least cost, of which the driver
sees sums a source and a pair of sources. Of several flows of least cost the two may take different ones.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import core

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, PASSES, SEED = 1.5, 2, 20
#: Bound of what the driver and a broadcast hold: rows of patterns and their owners. It says where the flow is found.
MAX_PATTERNS = 100_000
#: Patterns that one group of a running sum holds.
GROUP = 10_000
BUCKET_BITS = 12


def size_of(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(core.WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = PASSES) -> dict[str | None, float]:
    """Words wanted of each source: share of all by weight, at most `most` times its size; what is
    above goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * left / total > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * left / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: dict[tuple, Sequence[int]], quotas: dict, most: dict[tuple, int] | None = None) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources: a flow that meets the quotas as far as can
    be, at least cost. patterns: words at cost 0, 1, 2 ...; most: bounds of (pattern, source), none: no
    bound. All cost is on a pattern's own arc, so shortest augmenting paths are those that start with
    the cheapest open words: costs are opened one after another. What cannot reach a quota once never
    can again, and is passed over from then on."""
    flow: dict[tuple, dict] = {p: dict.fromkeys(p, 0) for p in patterns}
    left = {(p, s): (1 << 62) if most is None else most.get((p, s), 0) for p in patterns for s in p}
    room = dict(quotas)
    givers: dict = {}
    for p in patterns:
        for s in p:
            givers.setdefault(s, []).append(p)
    dead: set = set()
    nowhere = object()  # None is a source
    for level in range(max((len(c) for c in patterns.values()), default=0)):
        for p, costs in patterns.items():
            supply = costs[level] if level < len(costs) else 0
            while supply > 0:
                first = [s for s in p if left[p, s] > 0 and s not in dead]
                came: dict = {s: () for s in first}
                end = max((s for s in first if room.get(s, 0) > 0), key=lambda s: room[s], default=nowhere)
                queue = deque(first if end is nowhere else ())
                while queue and end is nowhere:
                    s = queue.popleft()
                    for q in givers[s]:  # what another pattern gives here, it could give elsewhere
                        if flow[q][s] > 0:
                            for t in q:
                                if t not in came and t not in dead and left[q, t] > 0:
                                    came[t] = (s, q)
                                    queue.append(t)
                                    if room.get(t, 0) > 0:
                                        end = t
                                        break
                        if end is not nowhere:
                            break
                if end is nowhere:
                    dead |= set(came)
                    break
                path, t = [], end
                while came[t]:
                    s, q = came[t]
                    path.append((s, q, t))
                    t = s
                amount = min([supply, room[end], left[p, t], *(flow[q][s] for s, q, _ in path), *(left[q, u] for _, q, u in path)])
                for s, q, u in path:
                    flow[q][s] -= amount
                    left[q, s] += amount
                    flow[q][u] += amount
                    left[q, u] -= amount
                flow[p][t] += amount
                left[p, t] -= amount
                room[end] -= amount
                supply -= amount
    return flow


def _name(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def _path(direct: dict, cap: dict, room: dict) -> list:
    """A shortest way from a source that open words can reach to one with room: the sources on it."""
    came: dict = {s: None for s, n in direct.items() if n > 0}
    queue = deque(sorted(came, key=lambda s: (-room.get(s, 0), s)))
    while queue:
        s = queue.popleft()
        if room.get(s, 0) > 0:
            path = [s]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            return path[::-1]
        for t in sorted(cap.get(s, ())):
            if t not in came:
                came[t] = s
                queue.append(t)
    return []


def _give(state: DataFrame, path: list, amount: int) -> DataFrame:
    """state after `amount` words more went in at the first source of the path and on along it: each step
    takes them from the first patterns that have any, by running sums of groups and within them."""
    steps = [_open_words(path[0]), *(_movable(F.lit(s), F.lit(t)) for s, t in zip(path, path[1:]))]
    caps = [f"_c{i}" for i in range(len(steps))]
    state = state.withColumns(dict(zip(caps, steps)))
    sums = state.groupBy("_group").agg(*(F.sum(c).alias(c) for c in caps))
    before = W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)  # a row a group
    sums = sums.select("_group", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in caps))
    inside = W.partitionBy("_group").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    state = state.join(F.broadcast(sums), "_group").withColumns({f"_r{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in caps})
    took = [F.greatest(F.lit(0), F.least(F.col(c), F.lit(amount) - F.col(f"_b{c}") - F.col(f"_r{c}"))) for c in caps]
    state = state.withColumns({f"_t{c}": t for c, t in zip(caps, took)})

    def change(k: Column) -> Column:
        out = F.lit(0).cast("long")
        for i, s in enumerate(path):
            gone = F.col(f"_t{caps[i + 1]}") if i + 1 < len(caps) else F.lit(0)
            out = F.when(k == s, F.col(f"_t{caps[i]}") - gone).otherwise(out)
        return out

    return state.select("_p", "_group", "costs", (F.col("supply") - F.col(f"_t{caps[0]}")).alias("supply"), F.transform_values("x", lambda k, v: v + change(k)).alias("x"), F.transform_values("left", lambda k, v: v - change(k)).alias("left"))


def _open_words(source: Column | str) -> Column:
    """Open words of a pattern that a source may take."""
    left = F.try_element_at("left", F.lit(source) if isinstance(source, str) else source)
    return F.when(left > 0, F.least("supply", left)).otherwise(0).cast("long")


def _movable(a: Column, b: Column) -> Column:
    """Words that a pattern gives to a and could give to b."""
    x, left = F.try_element_at("x", a), F.try_element_at("left", b)
    return F.when((x > 0) & (left > 0), F.least(x, left)).otherwise(0).cast("long")


def route_table(patterns: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """route() for patterns that stay in Spark. patterns: _p (name of the pattern), costs array<long> (words at
    cost 0, 1, 2 ...), left map<source, words that it may take>; quotas a source. Gives _p, _s, words.

    As there, costs are opened one after another and words go along shortest paths of sources; a path takes all
    patterns at once, up to the least sum of what its steps can move. A round reads the patterns twice or three times."""
    n = patterns.count()
    group = F.pmod(F.xxhash64("_p"), F.lit(max(1, -(-n // GROUP)))).cast("int")
    state = core.cut(patterns.select("_p", group.alias("_group"), "costs", F.lit(0).cast("long").alias("supply"), F.transform_values("left", lambda k, v: F.lit(0).cast("long")).alias("x"), "left"), "flow")
    levels = state.agg(F.max(F.size("costs"))).first()[0] or 0
    room = dict(quotas)
    for level in range(levels):
        opened = state.withColumn("supply", F.coalesce(F.get("costs", F.lit(level)), F.lit(0)))
        state, old = core.cut(opened, "flow"), state
        core.drop_cut(old)
        while any(r > 0 for r in room.values()):
            reach = state.where("supply > 0").select(F.explode(F.map_keys("left")).alias("s"), "supply", "left")
            direct = {r.s: r.n for r in reach.groupBy("s").agg(F.sum(_open_words(F.col("s"))).alias("n")).collect()}
            cap: dict = {}
            path = _path(direct, cap, room)
            if not path and any(direct.values()):
                pairs = state.select("x", "left", F.explode(F.map_keys(F.map_filter("x", lambda k, v: v > 0))).alias("s")).select("x", "left", "s", F.explode(F.map_keys(F.map_filter("left", lambda k, v: v > 0))).alias("t"))
                for r in pairs.where("s != t").groupBy("s", "t").agg(F.sum(_movable(F.col("s"), F.col("t"))).alias("n")).collect():
                    cap.setdefault(r.s, {})[r.t] = r.n
                path = _path(direct, cap, room)
            if not path:
                break
            amount = min([direct[path[0]], room[path[-1]], *(cap[s][t] for s, t in zip(path, path[1:]))])
            room[path[-1]] -= amount
            state, old = core.cut(_give(state, path, amount), "flow"), state
            core.drop_cut(old)
    return state.select("_p", F.explode("x").alias("_s", "words"))


def _once(slim: DataFrame) -> DataFrame:
    """A text's words count once for its pattern."""
    return slim.groupBy("_m", "_pos").agg(F.max("size").alias("size")).groupBy("_m").agg(F.sum("size").alias("words"))


def _plan(slim: DataFrame, totals: DataFrame, weights: Sequence[float], share: float, passes: int, owned: bool, shared: bool) -> tuple[DataFrame, dict, dict]:
    """Whole passes, rest and where the rest begins, of each pattern and owner; sizes and targets of sources."""
    rows = sorted(totals.collect(), key=lambda r: r._key)
    once: dict[tuple, int] = {}
    if shared:
        once = {tuple(r._m): int(r.words) for r in _once(slim).collect()}
    held: dict[tuple, int] = {}
    sizes: dict = {}
    for r in rows:
        p = tuple(r._m)
        held[p] = held.get(p, 0) + int(r.words)
        for s in r._own if owned else p:
            sizes[s] = sizes.get(s, 0) + int(r.words)
    wanted = targets(sizes, weights, share, passes)
    quotas = {s: round(t) for s, t in wanted.items()}
    patterns: dict[tuple, list[int]] = {}
    for p, n in held.items():
        first = min(n, once.get(p, n))
        patterns[p] = [first, min(first, passes * n - first), max(0, passes * n - 2 * first)]
    bounds = {(tuple(r._m), r._own[0]): passes * int(r.words) for r in rows} if owned else None
    flow = route(patterns, quotas, bounds)
    plan, used = [], {}
    for r in rows:
        p, n = tuple(r._m), int(r.words)
        total = flow[p].get(r._own[0], 0) if owned else sum(flow[p].values())
        # where the rest begins, in buckets around the circle of hashes: where this pattern's last one ended
        begin = used.get(p, 0.0)
        used[p] = (begin + (total % n / n if n else 0)) % 1
        plan.append((r._key, total // n if n else 0, total % n if n else 0, int(begin * (1 << BUCKET_BITS))))
    dealt = core.cut(slim.sparkSession.createDataFrame(plan, "_key string, _full long, _rest long, _begin int"), "plan")
    return dealt, sizes, wanted


def _plan_table(slim: DataFrame, totals: DataFrame, weights: Sequence[float], share: float, passes: int, owned: bool, shared: bool) -> tuple[DataFrame, dict, dict]:
    """_plan() for patterns that stay in Spark."""
    rows = totals.withColumn("_p", F.to_json(F.struct("_m"), {"ignoreNullFields": "false"}))
    sizes = {r.s: int(r.n) for r in rows.select(F.explode("_own" if owned else "_m").alias("s"), "words").groupBy("s").agg(F.sum("words").alias("n")).collect()}
    wanted = targets(sizes, weights, share, passes)
    owner = F.element_at("_own", 1)
    if owned:
        mine = F.when(F.exists("_m", lambda s: s.eqNullSafe(owner)), F.struct(_name(owner), (F.col("words") * passes)))
        left = F.map_from_entries(F.collect_list(mine))
    else:
        left = F.map_from_entries(F.transform(F.first("_m"), lambda s: F.struct(_name(s), F.lit(1 << 62))))
    held = rows.groupBy("_p").agg(F.sum("words").alias("n"), left.alias("left"))
    held = held.join(_once(slim).select(F.to_json(F.struct("_m"), {"ignoreNullFields": "false"}).alias("_p"), F.col("words").alias("first")), "_p") if shared else held.withColumn("first", F.col("n"))
    n, first = F.col("n"), F.least("n", "first")
    costs = F.array(first, F.least(first, passes * n - first), F.greatest(F.lit(0), passes * n - 2 * first))
    quotas = {"n" if s is None else "s" + s: round(t) for s, t in wanted.items()}
    flow = route_table(held.select("_p", costs.alias("costs"), "left"), quotas).withColumnRenamed("words", "_total")
    if owned:
        rows = rows.withColumn("_s", _name(owner)).join(flow, ["_p", "_s"], "left")
    else:
        rows = rows.join(flow.groupBy("_p").agg(F.sum("_total").alias("_total")), "_p", "left")
    words, total = F.col("words"), F.coalesce("_total", F.lit(0))
    rows = rows.withColumns({"_full": F.when(words > 0, F.floor(total / words)).otherwise(0).cast("long"), "_rest": F.when(words > 0, total % words).otherwise(0).cast("long")})
    before = W.partitionBy("_p").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.when(words > 0, F.col("_rest") / words).otherwise(0.0)).over(before), F.lit(0.0)) % 1
    return core.cut(rows.select("_key", "_full", "_rest", F.floor(begin * (1 << BUCKET_BITS)).cast("int").alias("_begin")), "plan"), sizes, wanted


def mix(docs: DataFrame, members: Column, size: Column, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = SEED, own: Column | None = None, text: Column | None = None) -> DataFrame:
    """docs with size and taken (words that the mix takes, repeats counted).

    members: array<string>, the sources that a document belongs to; own: if given, the one source that
    the document's words count for, whose size and target become source_size and target; text: a long
    that copies of a text share, for the cost of repetition (none: each row is a text of its own). Two
    passes over docs: narrow rows to plan by, then the decision by broadcast rows a pattern."""
    spark = docs.sparkSession
    at = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string") if text is None else text)
    whole = docs.withColumns({"size": size, "_m": F.sort_array(F.array_distinct(F.coalesce(members, F.array().cast("array<string>")))), "_own": F.array(own) if own is not None else F.lit(None).cast("array<string>")})
    key = F.to_json(F.struct("_m", "_own"), {"ignoreNullFields": "false"})
    whole = whole.withColumn("_key", key).withColumn("_pos", F.shiftrightunsigned(at, 1)).withColumn("_bucket", F.shiftright("_pos", 63 - BUCKET_BITS))
    slim = core.cut(whole.select("size", "_m", "_own", "_key", "_pos", "_bucket"), "slim")
    totals = core.cut(slim.groupBy("_key", "_m", "_own").agg(F.sum("size").alias("words")), "totals")
    many = totals.count() > MAX_PATTERNS
    buckets = core.cut(slim.groupBy("_key", "_m", "_own", "_bucket").agg(F.sum("size").alias("words")), "buckets")
    near = (lambda df: df) if many else F.broadcast
    if many:
        dealt, sizes, wanted = _plan_table(slim, totals, weights, share, passes, own is not None, text is not None)
    else:
        dealt, sizes, wanted = _plan(slim, totals, weights, share, passes, own is not None, text is not None)
    turn = F.pmod(F.col("_bucket") - F.col("_begin"), F.lit(1 << BUCKET_BITS))
    # the bucket, then the document in it, where the rest of a pattern is used up
    run = W.partitionBy("_key").orderBy("_turn")
    edge = buckets.join(near(dealt), "_key").where("_rest > 0").withColumn("_turn", turn).withColumn("_to", F.sum("words").over(run)).where("_to >= _rest and _to - words < _rest")
    edge = core.cut(edge.select("_key", "_bucket", "_turn", (F.col("_rest") - F.col("_to") + F.col("words")).alias("_left")), "edge")
    inside = slim.select("_key", "_bucket", "_pos", "size").join(near(edge.drop("_turn")), ["_key", "_bucket"]).groupBy("_key", "_left", "_pos").agg(F.sum("size").alias("words"))
    inside = inside.withColumn("_to", F.sum("words").over(W.partitionBy("_key").orderBy("_pos"))).where("_to >= _left and _to - words < _left")
    cutoff = inside.select("_key", F.col("_pos").alias("_cut"), (F.col("_left") - F.col("_to") + F.col("words")).alias("_part"), F.col("words").alias("_words"))
    decide = core.cut(dealt.join(edge.select("_key", F.col("_turn").alias("_last")), "_key", "left").join(cutoff, "_key", "left"), "mix")
    out = whole.join(near(decide), "_key", "left").withColumn("_turn", turn)
    extra = (
        F.when((F.col("_rest") == 0) | (F.col("_turn") > F.col("_last")), 0)
        .when((F.col("_turn") < F.col("_last")) | (F.col("_pos") < F.col("_cut")), F.col("size"))
        .when(F.col("_pos") == F.col("_cut"), F.floor(F.col("size") * F.col("_part") / F.col("_words")))
        .otherwise(0)
    )
    out = out.withColumn("taken", (F.col("size") * F.coalesce("_full", F.lit(0)) + F.coalesce(extra, F.lit(0))).cast("long"))
    if own is not None:
        by = spark.createDataFrame([(s, sizes[s], wanted[s]) for s in sizes], "_name string, source_size long, target double")
        out = out.drop("source_size", "target").join(F.broadcast(by), F.element_at("_own", 1).eqNullSafe(by._name), "left")
    for old in (slim, buckets, dealt, edge, totals):
        core.drop_cut(old)
    return out.drop("_m", "_own", "_key", "_pos", "_bucket", "_full", "_rest", "_begin", "_last", "_cut", "_part", "_words", "_turn", "_name")


def mix_copies(docs: DataFrame, size: Column, text: Column, source: str = "source", **how) -> DataFrame:
    """mix() where a document belongs to all sources that hold its text (a long that copies share) and
    counts for its own. One shuffle of (text, source) pairs, summed before it; texts of several
    sources are joined back."""
    held = docs.withColumn("_text", text)
    several = held.groupBy("_text").agg(F.collect_set(F.struct(source)).alias("_in")).where(F.size("_in") > 1)
    several = core.cut(several.select("_text", F.transform(F.sort_array("_in"), lambda x: x[source]).alias("_in")), "several")
    held = held.join(several, "_text", "left").withColumn("_in", F.coalesce("_in", F.array(source)))
    return mix(held, F.col("_in"), size, own=F.col(source), text=F.col("_text"), **how).drop("_text", "_in")


def copies(mixed: DataFrame) -> DataFrame:
    """One row for each time that the mix takes a document; the one at an edge comes whole, or not
    at all when less than half of it was left."""
    n = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    return mixed.where(n >= 1).withColumn("_copy", F.explode(F.sequence(F.lit(1), n))).drop("_copy", "size", "taken")
