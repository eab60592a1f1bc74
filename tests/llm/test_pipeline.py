"""The pipeline on a small folder of tables, stage by stage against plain Python."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from harrow.llm import pii

from .brute import components, measures, shingles, words

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def corpus():
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(2000)]
    rows = []
    for i in range(150):
        w = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 40, 90]))]
        rows.append((len(rows), " ".join(w), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None])))
        if i % 4 == 0:
            rows.append((len(rows), " ".join(w + [rng.choice(vocab)]), "en", "b"))
        if i % 5 == 0:
            rows.append((len(rows), " ".join([*w, "mail", "x.y@a.example.com", "or", "9.9.9.9"] + [rng.choice(vocab) for _ in range(12)]), "en", "a"))
    rows += [(len(rows), None, "en", "a"), (len(rows) + 1, "", None, None), (len(rows) + 2, "a b c d e " * 10, "en", "a")]
    return [(*r, len(r[1] or "")) for r in rows]


def test_stages(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(P.STAGES):
        got = stage(spark, docs, str(tmp_path))
        got.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out[name] = docs.collect()
    good = {r[0]: r for r in rows if not measures(r[1])[5]}
    assert {r.doc_id for r in out["quality rules"]} == set(good)
    sets = {d: shingles(r[1]) for d, r in good.items()}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(sets, links)
    kept = {d for d in comp if comp[d] == d}
    assert len(kept) < len(good) and {r.doc_id for r in out["near-duplicates"]} == kept
    field = pii.trained()
    for r in out["personal data"]:
        t = good[r.doc_id][1]
        b = pii.base_spans(t)
        assert r.text == pii.mask(t, sorted(b + pii.field_spans(t, b, field))) and r.n_chars == len(r.text) and "@" not in r.text
    size, taken = {}, {}
    for r in out["personal data"]:
        size[r.source] = size.get(r.source, 0) + len(words(r.text))
    for r in out["mix"]:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 400 and all(taken[s] <= 2 * size[s] for s in taken)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = {r.doc_id: r.text for r in out["mix"]}
    assert len(out["encode"]) == len(out["mix"])
    for r in out["encode"]:
        ids = t.encode(by[r.doc_id], add_special_tokens=False).ids
        assert list(memoryview(bytes(r.ids)).cast("I")) == ids and r.n_tokens == len(ids)


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_other_columns_and_repeated_rows(spark, tmp_path):
    """Columns of any name pass through all stages; a repeated row counts once among near-duplicates."""
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text, "en", "a", 5, 7, True, 1.5, "s"), (1, text, "en", "a", 5, 7, True, 1.5, "s"), (2, text + " x", "en", "a", 5, 8, True, 1.5, "s"), (3, other, "en", "b", 5, 9, False, None, None), (3, text + " y", "en", "b", 5, 9, False, None, None)]
    docs = spark.createDataFrame(rows, DOCS + ", size int, kept boolean, taken double, base string").withColumn("spans", F.lit("k")).withColumn("n_words", F.lit(3))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and {(r.spans, r.n_words) for r in got.collect()} == {("k", 3)}
        got.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 1:
            assert sorted((r.doc_id, r.text[0], r["size"], r.kept) for r in docs.collect()) == [(1, "w", 7, True), (3, "v", 9, False)]
