"""The registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, fim_frames, fm_dedup, jaccard_join, packing, quality_rules, secret_scan, simhash, suffix_dedup, suffix_tree_lm, toxicity, vector_codes
from .common import read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit_chain(docs, toxicity.category_labels(read(spark, sf_dir, "labels")))
    return toxicity.score(docs, chain).select("doc_id", "p_low_quality", "p_toxic", "is_toxic")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark")))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_preferences(chat.neighbour_pairs(read(spark, sf_dir, "conversations"))))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).drop("kept")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("node")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).drop("kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_frames.digest(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(quality_rules.judge(quality_rules.repetition(read(spark, sf_dir, "documents").select("doc_id", "text"), detail=False)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_benchmark_decontamination": decontaminate.ORACLE, "op3_chat_formatting": chat.ORACLE, "op6_substring_dedup": fm_dedup.ORACLE, "op7_ngram_jaccard_join": jaccard_join.ORACLE,
        "op10_suffix_array_dedup": suffix_dedup.ORACLE, "op11_fill_in_middle": fim_frames.ORACLE, "op13_quality_rules": quality_rules.ORACLE,
    }
