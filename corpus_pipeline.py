"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its
result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from chainloom import session
from chainloom.llm import common, language, near_dedup, packing, queries, surrogates, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't hold
    for toxic."""
    common.prepare(spark)
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.with_score(docs, model, out="_score").where(F.col("_score") < toxicity.THRESHOLD).drop("_score")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told, with that language; without any labelled
    language, all that have a letter."""
    common.prepare(spark)
    model = language.train(docs, ~common.held_out())
    if model is None:  # no row is labelled: nothing can be told, but texts without a letter
        return docs.where(F.col("text").rlike(r"\p{L}")).withColumn("lang", F.lit(language.UNKNOWN))
    told = language.with_language(docs, model, out="_language").where(F.col("_language.pred") != language.UNKNOWN)
    return told.withColumn("lang", F.col("_language.pred")).drop("_language")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    common.prepare(spark)
    return near_dedup.deduplicated(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    common.prepare(spark)
    replaced = surrogates.with_surrogates(docs, queries.PII_KEY, kinds="_kinds").drop("_kinds")
    return replaced.withColumn("n_chars", F.length("text").cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of a fixed number of tokens."""
    common.prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("packing", pack),
]

# The learned stages can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(common.prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = session.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
