"""The registered query of each corpus operator: the whole intended table in, its full result out."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, langid, lattice, maxent_lm, mixing, negatives, quality, repair, secret_scan, sharding, simhash, spm
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.lm_report(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


#: A public BPE vocabulary of 32,000 pieces; the folder is a parameter of the environment, not part of the library.
TOKENIZERS = os.environ.get("TIDEWELL_TOKENIZERS", "/opt/tokenizers")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spm.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_report(table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.negatives_report(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_exact_dedup, op3_lattice_near_dedup, op4_simhash_near_dedup, op5_lm_scoring, op6_quality_classifier, op7_source_mixing, op8_sentencepiece, op9_sharding, op10_secret_scan, op11_chat_formatting, op12_hard_negatives, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE, "op7_source_mixing": mixing.ORACLE, "op11_chat_formatting": chat.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_conversation_repair": repair.ORACLE}
