import math
import random

from pyspark.sql import functions as F

from harrow.llm import quality

from .brute import measures


def texts(seed=1, n=120):
    rng = random.Random(seed)
    vocab = ["a", "bb", "#c", "d*", "éé", "|", "x1", "word", "the", "<b>"]
    out = [None, "", " \n\t", "one", "a b c d e a b c d e f g h i j k l m n", "x\n" * 30, "a" * 500, "a b" + " c d\x1ce f g h i j k"]
    for _ in range(n):
        k = rng.randint(1, 80)
        out.append("".join(rng.choice(vocab) + rng.choice([" ", "  ", "\n", "\t", "\r\n", " "]) for _ in range(k)))
    return out


def test_measures(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string")
    for r in quality.features(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(r.text), r


def test_binomial_tail(spark):
    cases = [(0, 10, 0.01), (3, 1000, 0.01), (5, 1000, 0.01), (40, 20000, 0.0025), (1, 3000, 0.005), (9, 10, 0.5), (0, 0, 0.1), (700, 100000, 0.01)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        if n == 0 or k >= n * p:
            assert got == 1.0
            continue
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)) for j in range(k + 1))
        assert abs(got - want) <= 1e-9 * want, (k, n, p, got, want)


def test_cutoffs_hold_their_promise(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(4000):
        bad = i % 4 == 0
        w = ["w%d" % rng.randint(0, 9999) for _ in range(40)]
        if bad:
            w = [x + "###" for x in w]
        docs.append((i, " ".join(w), rng.choice(["en", "en", "en", "xx", None])))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(5000, None, "en"), (5001, "", "de"), (5002, "a b c", None)]
    d = spark.createDataFrame(docs, "doc_id int, text string, lang string")
    lab = spark.createDataFrame(labels + [(1, 1, 0), (None, 1, 0), (9999, None, None)], "doc_id int, quality int, toxic int")
    out = {r.doc_id: r for r in quality.verdicts(d, lab).collect()}
    assert len(out) == len(docs)
    good = [out[i].kept for i in range(4000) if i % 4]
    assert good.count(False) <= quality.ALPHA * len(good)
    assert not any(out[i].kept for i in range(0, 4000, 4) if out[i].lang == "en")
    assert not out[5000].kept and not out[5001].kept and not out[5002].kept
    few = {r.doc_id: r for r in quality.verdicts(d, lab.limit(0)).collect()}
    assert all(r.kept != r.base_failed for r in few.values())
    assert quality.verdicts(d.limit(0), lab).count() == 0


def test_acts_on_the_given_table(spark):
    """Rows beyond the base rule go, few of them labelled good, and the verdict is the SQL twin's."""
    t = {n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels")}
    out = quality.verdicts(t["documents"], t["labels"]).select("doc_id", "stratum", "base_failed", "kept").collect()
    gone = {r.doc_id for r in out if not r.kept and not r.base_failed}
    assert len(gone) >= 20 and {r.stratum for r in out if r.doc_id in gone} == {"en"}
    good = {r.doc_id for r in t["labels"].where("quality = 1 and toxic = 0").collect()}
    assert len(gone & good) <= quality.ALPHA * len(good)


def test_copies_are_one_trial(spark):
    def cuts(n, copies):
        docs = [(k * n + i, f"w{i} " * 4 + " ".join(f"x{i}y{j}" for j in range(20)), "en") for i in range(n) for k in range(copies)]
        d = quality.features(spark.createDataFrame(docs, "doc_id int, text string, lang string"))
        d = d.withColumns({"stratum": quality.stratum(), "step": quality.strictness(), "text_hash": F.xxhash64("text")})
        labels = spark.createDataFrame([(r[0], 1, 0) for r in docs], "doc_id int, quality int, toxic int")
        return quality.calibrate(d, labels).first()

    assert cuts(40, 10).cut is None and cuts(40, 10).n_good == 40
    assert cuts(400, 1).cut == quality.STEPS - 1


def test_steps_are_ordered():
    assert all(len(c) == quality.STEPS and sorted(c, reverse=True) == list(c) for c in quality.GRID.values())
