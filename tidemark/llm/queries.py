"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, language, lm, mixing, nearcopies, oracles, packing, quality, toxicity, urlrules, vectorcodes, warc, winnow

RANKS = "byte_bpe_multi_50k.tiktoken"
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document, and the verdict of cutoffs certified on ``labels`` per language."""
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, packed into rows of 2048, written to files, and read back from them."""
    packs = packing.write_packed(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return packing.read_packed(packs)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last half comes from the next document."""
    return winnow.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document under sets of four-word shingles and a similarity of 0.8."""
    out = nearcopies.groups(table(spark, sf_dir, "documents"), size=4, threshold=0.8)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mixing.mix(table(spark, sf_dir, "documents"), narrow=True)
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    return language.predict(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and self-attention scores of every document, learned from those that aren't held out."""
    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, and each capture looked up in their index and read back."""
    return warc.read(warc.write(table(spark, sf_dir, "pages")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document with its pieces put in another order, and of the text restored from that."""
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every embedding, under codebooks refined over all of them."""
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled ones that aren't held out."""
    return toxicity.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ALL = [
    op1_quality_rules, op2_packing, op3_byte_bpe, op4_winnowing, op5_hyperminhash_dedup, op6_source_mixing, op7_language_id, op8_url_filters, op9_lm_scoring, op10_warc_index, op11_fill_in_middle, op12_vector_codes,
    op13_toxicity,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    own = {"op5_hyperminhash_dedup": oracles.OP5, "op6_source_mixing": oracles.OP6, "op8_url_filters": oracles.op8(URL_RULES), "op10_warc_index": oracles.OP10}
    return own | {"op11_fill_in_middle": oracles.OP11, "op12_vector_codes": oracles.OP12}
