"""Quality rules whose cutoffs carry a risk guarantee, in DataFrame functions only.

The rules reject a text together: each measure has a cutoff, and a text goes when any measure exceeds
its own. Labelled texts choose how strict the cutoffs are. For a stratum (a language) the steps of GRID
are tested from the mildest to the strictest, each against "at this step the rules reject more than
ALPHA of the good texts", by the exact binomial tail of the good texts that it would reject. A sequence
stops at its first step that fails (fixed-sequence testing), so that all its steps together spend the
stratum's error once; DELTA is dealt to the strata by their documents, labelled or not (weighted
Bonferroni correction). With probability 1 - DELTA no stratum loses more than ALPHA of its good texts.
A trial is a distinct text: copies count once, good only if all their labels say so.

Defined results: null and empty texts have no words and fail the base rule; a null or unlisted
language belongs to the stratum "other"; a stratum without enough good labels rejects nothing beyond
the base rule; repeated label rows count once (worst quality, worst toxicity), labels with nulls or
without a document not at all; repeated documents are judged each. The measures and the columns of
this module replace columns of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

ALPHA, DELTA = 0.02, 0.05
STRATA = ("de", "en", "es", "fr")
#: Rule -> cutoffs, one a step, from the mildest to the strictest; fixed before any label is seen.
GRID = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2),
    "repeat_share": (0.2, 0.19, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05),
    "word_length": (40.0, 30.0, 25.0, 22.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0),
}
STEPS = 10
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five base measures, the rules' measures and base_failed; no shuffle.

    Repeated five-word windows are found by sorting (hash, position) of a text's windows, and only
    in texts that have any; a 64-bit hash stands for a window within its text."""
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("_t", t).withColumn("_w", F.regexp_extract_all("_t", F.lit(core.WORD), F.lit(0)))
    step = step.withColumn("n_words", F.size("_w").cast("long"))
    step = step.withColumn("word_chars", F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"))
    step = step.withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long"))
    step = step.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    step = step.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    step = step.withColumn("_n_lines", F.size("_l"))
    window = lambda x, i: F.xxhash64(x, *[F.get("_w", i + k) for k in range(1, 5)])
    step = step.withColumn("_h", F.slice(F.transform("_w", window), 1, F.greatest(F.size("_w") - 4, F.lit(0))))
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    step = step.withColumn("_p", F.when(twice, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda p, k: (p["h"] == F.get("_p", k + 1)["h"]) | (p["h"] == F.get("_p", F.when(k > 0, k - 1))["h"])
    step = step.withColumn("_q", F.sort_array(F.transform(F.filter("_p", same), lambda p: p["i"])))
    # each repeated window adds its words up to where the next one begins
    gaps = F.transform("_q", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_q", k + 1) - p, F.lit(5))).cast("long"))
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    words = F.greatest(F.col("n_words"), F.lit(1))
    return step.withColumns(
        {
            "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / words,
            "word_length": F.col("word_chars") / words,
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    ).drop("_t", "_w", "_l", "_n_lines", "_h", "_p", "_q")


def stratum(lang: Column | str = "lang") -> Column:
    lang = F.col(lang) if isinstance(lang, str) else lang
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def log_gamma(x: Column) -> Column:
    """Stirling's series eight places up, then down again; for x of at least 1."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - reduce(lambda a, b: a + b, (F.log(x + k) for k in range(8)))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of Binomial(n, p): the exact sum, from its largest term down; terms of more
    than 40 standard deviations away are below any double. 1 where k is not under the mean."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    least = F.greatest(F.lit(0), (k - 100 - 40 * F.sqrt(n * p)).cast("long"))
    down = F.aggregate(
        F.when(k >= 1, F.sequence(k.cast("long"), F.least(least + 1, k.cast("long")))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * j / (n - j + 1) * ((1 - p) / p)).alias("term"), (a["sum"] + a["term"] * j / (n - j + 1) * ((1 - p) / p)).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(n <= 0, 1.0).when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), top * down))


def strictness() -> Column:
    """The mildest step at which some rule rejects the text; STEPS where none does."""
    return F.least(*[reduce(lambda a, b: a + b, [(F.col(r) <= c).cast("int") for c in cs]) for r, cs in GRID.items()])


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cut (the strictest step that holds; null: nothing is rejected), n_good, n_rejected (good
    texts at that step), level (the stratum's part of delta). One row a stratum with labels.

    measured: features() with stratum, step and text_hash. Shuffles are of narrow rows, by document and
    by text; counts are summed before they are sent."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    texts = measured.where(~F.col("base_failed")).join(one, "doc_id").groupBy("stratum", "text_hash").agg(F.min("step").alias("step"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = texts.where("quality = 1 and coalesce(toxic, 0) = 0")
    counts = good.groupBy("stratum").agg(F.count("*").alias("n_good"), F.array(*[F.count(F.when(F.col("step") <= i, 1)) for i in range(STEPS)]).alias("ks"))
    whole = measured.agg(F.count("*").alias("all"))
    shares = measured.groupBy("stratum").agg(F.count("*").alias("n")).join(F.broadcast(whole)).select("stratum", (delta * F.col("n") / F.col("all")).alias("level"))
    tested = counts.join(F.broadcast(shares), "stratum").select("stratum", "n_good", "level", F.posexplode("ks").alias("at", "k"))
    tested = tested.withColumn("p_value", binomial_tail(F.col("k"), F.col("n_good"), alpha))
    # the steps before the first that failed hold; the last of them is the cut
    failed = F.coalesce(F.min(F.when(F.col("p_value") > F.col("level"), F.col("at"))), F.lit(STEPS))
    found = tested.groupBy("stratum").agg(failed.alias("failed"), F.max("n_good").alias("n_good"), F.max("level").alias("level"), F.collect_list(F.struct("at", "k")).alias("steps"))
    last = F.array_max(F.filter("steps", lambda s: s["at"] < F.col("failed")))
    return found.select("stratum", last["at"].alias("cut"), "n_good", last["k"].alias("n_rejected"), "level")


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """measured with `kept`. cuts has one row a stratum, at most 5, and so is sent to all."""
    out = measured.join(F.broadcast(cuts.select("stratum", F.col("cut").alias("_cut"))), "stratum", "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("step") <= F.col("_cut"), F.lit(False))).drop("_cut")


def verdicts(docs: DataFrame, labels: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with measures, stratum, step and kept, and with the text only if keep_text. The measures are
    written once and read for the calibration and the verdict. (A filter on `kept` over unwritten
    measures would have the optimizer copy their expressions into it again and again.)"""
    measured = features(docs, text).withColumns({"stratum": stratum(), "step": strictness(), "text_hash": F.xxhash64(text)})
    measured = core.cut(measured if keep_text else measured.drop(text), "measures")
    return judge(measured, core.cut(calibrate(measured, labels), "cutoffs"))
