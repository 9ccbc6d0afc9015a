"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import centroids, chat, decontamination, embedding_dedup, jaccard, language_id, licenses, packing, secrets, spelling, suffix_dedup, token_counts, toxicity
from logloom.llm.shared import read_table


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary())


def learned_languages(documents: DataFrame) -> dict[str, bytes]:
    """Training texts from labelled documents outside the held-out third."""
    return language_id.sample_texts(documents.filter(f"lang is not null and text is not null and {fold(3)} <> 1"))


def fold(n: int) -> str:
    return f"crc32(cast(doc_id as string)) % {n}"


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    train = f"{fold(5)} <> 0"
    texts, y, held = toxicity.sample(documents, labels.filter(train), f"{fold(5)} = 1")
    languages = language_id.sample_texts(documents.filter(f"lang is not null and text is not null and {train}"))
    model = toxicity.train(texts, y, held, languages)
    found = toxicity.classify(documents, model)
    return found.select("doc_id", F.expr(f"{fold(5)} = 0").alias("held_out"), "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    found = language_id.identify(documents.select("doc_id", "text"), learned_languages(documents))
    return found.select("doc_id", F.expr(f"{fold(3)} = 1").alias("held_out"), "lang_pred", "score")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(read_table(spark, sf_dir, "embeddings"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_similar(read_table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    found = secrets.scan(read_table(spark, sf_dir, "documents"), model)
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read_table(spark, sf_dir, "embeddings"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chats(chat.with_probe(read_table(spark, sf_dir, "conversations"))))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_toxicity, op3_language_id, op4_embedding_near_dedup, op5_ngram_jaccard_join, op6_secret_scan, op7_packing, op8_suffix_array_dedup, op9_license_scan, op10_decontamination]
    found += [op11_centroid_clustering, op12_chat_formatting, op13_spelling_variants]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_license_scan": licenses.oracle_sql(), "op11_centroid_clustering": centroids.oracle_sql(), "op12_chat_formatting": chat.oracle_sql()}
