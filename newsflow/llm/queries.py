"""Registered queries of the corpus operators: (spark, table folder) -> DataFrame.

Each query applies one operator with its production parameters to the whole table
and derives the agreed digest columns from the operator's own result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import (
    byte_bpe,
    collocations,
    compression_rules,
    decontamination,
    language_id,
    mixing,
    ngram_join,
    oracles,
    packing,
    quality_model,
    secret_scan,
    sharding,
    token_alignment,
    token_counts,
)
from newsflow.session import settled

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Shingle set size and near-duplicate component of every document."""
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, folder, "documents")
    model = quality_model.train(docs, table(spark, folder, "labels"))
    scored = docs.select("doc_id", quality_model.score(model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(quality_model.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality_model.KEEP_FROM).cast("int").alias("predicted"),
    )


def op3_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as packed token rows."""
    return packing.pack_tokens(table(spark, folder, "documents"))


def op4_compression_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return compression_rules.compression_rules(table(spark, folder, "documents"))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.scan_secrets(table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark words and items in every document."""
    found = decontamination.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token count of every document."""
    return token_counts.count_tokens(table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document."""
    _, totals = mixing.mix(table(spark, folder, "documents"))
    return totals.select("doc_id", "size", "source_size", "target", "taken")


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_documents(table(spark, folder, "documents"), shards=8).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, folder, "documents")
    found = language_id.identify(docs, language_id.learn(docs))
    held_out = F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "reliable")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations.mine_phrases(table(spark, folder, "documents"))


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and what they decode to, as digests."""
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, folder, "documents")))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between two tokenizers in every document."""
    aligned = token_alignment.align(table(spark, folder, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = settled(aligned.withColumn("groups_sha256", digest).drop("groups"), "token-alignments")
    return token_alignment.judge(aligned, token_alignment.pair_counts(aligned))


def queries() -> dict[str, Query]:
    found = [
        op1_ngram_join, op2_quality_classifier, op3_token_packing, op4_compression_rules,
        op5_secret_scan, op6_decontamination, op7_token_counts, op8_mixing, op9_sharding,
        op10_language_id, op11_collocations, op12_byte_bpe, op13_token_alignment,
    ]
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
