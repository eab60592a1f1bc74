"""From raw documents to token ids: quality rules, near-duplicates, personal data, the mix, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the
last return the columns of documents; n_chars follows the text. Any of them may hold nulls: a text of
null fails the quality rules; the other columns pass through, whatever they are called: a stage sees
those beyond the five of documents under names of its own and gives them back. Rows of equal doc_id
and equal text are one document to the near-duplicate stage, and so are rows of one doc_id whose texts
differ only in white space or the case of A-Z; other texts of one doc_id each stay or go by their own
links. A row without doc_id is kept there.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import bpe, core, jaccard, mixing, pii, quality

FIVE = ("doc_id", "text", "lang", "source", "n_chars")


def passing_others(stage):
    """The stage with columns beyond the five of documents hidden from it, and given back after it."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = {c: f"_other{i}" for i, c in enumerate(docs.columns) if c not in FIVE}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(others.get(c, c)) for c in docs.columns]), sf_dir)
        return out.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])

    return run


@passing_others
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rule or the risk-controlled cutoffs reject."""
    judged = quality.verdicts(docs, core.table(spark, sf_dir, "labels"), keep_text=True)
    return judged.where("kept").select(*docs.columns)


@passing_others
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked ones: the one with the smallest doc_id."""
    found = jaccard.near_duplicates(docs).where("doc_id = component_id")
    texts = found.groupBy("doc_id", "set_id", "n_shingles", "text_key").agg(F.count("*").alias("_rows"))
    first = texts.groupBy("doc_id", "set_id", "n_shingles").agg(F.min(F.struct("text_key", "_rows")).alias("_f"))
    one = core.cut(first.select("doc_id", F.col("_f.text_key").alias("_text"), "_f._rows"), "kept")
    keyed = docs.where("doc_id is not null").withColumn("_text", F.xxhash64("text"))
    kept = keyed.join(one, ["doc_id", "_text"])
    if one.where("_rows > 1").head(1):  # rows that repeat a doc_id with its text
        kept = kept.where("_rows = 1").unionByName(kept.where("_rows > 1").dropDuplicates(["doc_id", "_text"]))
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))


@passing_others
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a kind in brackets where personal data was."""
    masked = pii.find(docs, masked="text")
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@passing_others
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents so that the sources come near their targets."""
    return mixing.copies(mixing.mix_copies(docs, mixing.size_of(), F.xxhash64("text"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    out = bpe.transcode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "source", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mix", mix_sources),
    ("encode", encode),
]
#: No SQL: the cutoffs need binomial tails, the mix a seeded hash, the ids a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = core.cut(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
