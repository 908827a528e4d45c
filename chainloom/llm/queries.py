"""The registered queries of the operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from chainloom.llm import byte_bpe, common, hard_negatives, language, licenses, near_dedup, neighbours, packing, prefix_trie, quality, surrogates, token_counts, toxicity, wrapper

# The key of the registered queries; a real corpus takes a secret one.
PII_KEY = b"key of the registered queries"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(common.prepare(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.with_score(docs, model).select(
        "doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


@query()
def op2_stable_projection_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.text_or_empty().alias("text"))
    counted = token_counts.with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.with_round_trip(docs, *ranks)
    return coded.select(
        "doc_id", F.size("coded.ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("coded.ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


@query()
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.with_surrogates(docs, PII_KEY).withColumn("n_entities", F.size("entity_kinds"))


@query()
def op6_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query()
def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs, ~common.held_out())
    return language.with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", common.held_out().alias("held_out"), F.col("language.pred").alias("lang_pred"), F.col("language.score").alias("score")
    )


@query()
def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query(quality.ORACLE)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.cascade(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(hard_negatives.ORACLE)
def op11_bond_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mined(rows, F.col("vec_id") % 100 == 0)


@query()
def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.with_scan(docs).select(
        "doc_id", "scan.n_words", "scan.n_base", "scan.first_word", "scan.last_word", F.array_join("scan.base_labels", ",").alias("base_labels"),
        F.array_join("scan.labels", ",").alias("labels"), "scan.score", F.size("scan.spans").alias("n_spans"),
    )


@query(prefix_trie.ORACLE)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
