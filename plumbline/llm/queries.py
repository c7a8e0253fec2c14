"""The corpus queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bitpack, chats, decontaminate, hostrules, importance, licences, minhash, packing, quality, repeats, secrets, separators, spelling
from plumbline.session import table


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_separator_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.count_tokens(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.round_trip(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.render(table(spark, sf_dir, "conversations"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def host_rules_of_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge_sections(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_separator_token_counts": op2_separator_token_counts,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_licence_scan": op7_licence_scan,
    "op8_bit_packed_tokens": op8_bit_packed_tokens,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_host_quality_rules": op10_host_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_suffix_repeats": op12_suffix_repeats,
    "op13_importance_resampling": op13_importance_resampling,
    "host_rules_of_sections": host_rules_of_sections,
}

ORACLE: dict[str, str] = {"op5_chat_formatting": chats.RENDER_SQL, "op10_host_quality_rules": hostrules.JUDGE_SQL, "op11_spelling_variants": spelling.VARIANTS_SQL, "op13_importance_resampling": importance.RESAMPLE_SQL, "host_rules_of_sections": hostrules.SECTIONS_SQL}
