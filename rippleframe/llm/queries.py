"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm import bpe, decontam, lines, merkle, pii, qda, resampling, rules, suffixes, superminhash, tokencount, toxicity, urls
from rippleframe.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(table(spark, sf_dir, "documents"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op5_suffix_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op6_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text that stays."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), changed=merkle.without_line_feeds())


QUERIES: dict[str, Query] = {
    "op1_pii_disclosure": op1_pii_disclosure,
    "op2_template_decontamination": op2_template_decontamination,
    "op3_quality_rules": op3_quality_rules,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_suffix_refinement": op5_suffix_refinement,
    "op6_toxicity_ftrl": op6_toxicity_ftrl,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_qda": op8_quality_qda,
    "op9_url_automaton": op9_url_automaton,
    "op10_superminhash": op10_superminhash,
    "op11_token_counts": op11_token_counts,
    "op12_target_resampling": op12_target_resampling,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": rules.ORACLE,
    "op10_superminhash": superminhash.ORACLE,
    "op9_url_automaton": urls.ORACLE,
    "op12_target_resampling": resampling.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
