"""The registered queries of this package: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import table
from .oracle import ORACLE_SQL as ORACLE_SQL


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import core, mixing

    sized = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of().alias("words"), F.xxhash64("text").alias("text"))
    sized = core.cut(sized, "sizes")  # the texts are read once
    return mixing.mix_copies(sized, F.col("words"), F.col("text")).select("doc_id", "size", "source_size", "target", "taken", "source")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_mixing aims at: the columns of its result that SQL can express."""
    return op1_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.verdicts(docs, table(spark, sf_dir, "labels")).select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings

    return substrings.digests(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.digest_rows(table(spark, sf_dir, "pages"))


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import lattice_lm

    return lattice_lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import embeddings

    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.digests(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import phrases

    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import pieces

    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import align

    return align.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "mix_targets": mix_targets,
    "op2_quality": op2_quality,
    "op3_substrings": op3_substrings,
    "op4_jaccard": op4_jaccard,
    "op5_warc": op5_warc,
    "op6_lattice": op6_lattice,
    "op7_embeddings": op7_embeddings,
    "op8_pii": op8_pii,
    "op9_html": op9_html,
    "op10_bpe": op10_bpe,
    "op11_phrases": op11_phrases,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_alignment": op13_alignment,
}
