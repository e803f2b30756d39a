"""From documents to token ids: language, quality, near copies, mixture, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm import bpe, language, mixing, nearcopies, quality
from tidemark.llm.queries import RANKS
from tidemark.llm.shared import fresh, scope, staged

#: A document whose two best languages are closer than this has none.
LEAST_SCORE = 0.02


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, null texts among them, and those whose language is a toss-up.

    Rows with null or repeated ids are judged like all others; an empty table stays empty.
    """
    samples = language.learn(docs.where("doc_id IS NOT NULL").where(~language.held_out()))
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    rows = language.identify(docs, samples, pred, score)
    return rows.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or a certified cutoff of their language reject.

    Null, empty and blank texts fail the base; rows with null ids are judged without being learned from. Measures are
    computed once, into a staged table. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    rated = staged(quality.add_rules(quality.text_measures(rows, keep=["row", "doc_id", "lang"])), "quality")
    return quality.apply_rules(rated, quality.learn_cutoffs(rated, labels, "lang"), "lang").where("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; of rows with one id the first by text, without an id all."""
    kept = nearcopies.groups(docs, size=5, threshold=0.8).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    first = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("text"))
    found = docs.join(kept, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id", "text").withColumn("n", F.row_number().over(first)).where("n = 1").select("row.*")
    return found.unionByName(docs.where("doc_id IS NULL"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; documents without words only in whole copies, an empty table stays empty."""
    mixed = mixing.mix(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source"))
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and ids of every document, repeated rows included; a null text has no ids."""
    return bpe.tokenize(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ["doc_id", "source", "lang"])


STAGES = [("language ID", language_id), ("quality rules", quality_rules), ("near copies", near_copies), ("source mixture", source_mixture), ("token ids", token_ids)]

#: The stages can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again.

    What a stage wrote on its way, and the rows that it began with, are deleted when its own rows are there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope() as mine:
        for i, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if i < len(STAGES) - 1:
                docs = staged(docs, f"stage-{i}-{name.replace(' ', '-')}")
                mine.clean(spark, (f"/stage-{i}-",))
    return docs
