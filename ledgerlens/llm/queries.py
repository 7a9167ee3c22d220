"""Registered queries of the training-data operators: each reads its whole table
and returns its operator's whole result with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, filter_audit, html_extract, language_id, license_scan, lm_score, mixing, quality_qda,
               secret_scan, simhash_dedup, syncmer, token_align, toxicity)
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return fn
    return deco


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op2_html_extract")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


@query("op3_mixing", mixing.mix_oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@query("op4_license_scan", license_scan.scan_oracle())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


@query("op5_lm_score")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read(spark, sf_dir, "documents"))


@query("op6_decontaminate")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op7_syncmer")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer.edited_fingerprints(read(spark, sf_dir, "documents"))


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op9_secret_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed secrets only; the operator also reports what it rejected."""
    return secret_scan.scan(read(spark, sf_dir, "documents")).where("is_secret").drop("is_secret")


@query("op10_simhash_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(read(spark, sf_dir, "documents"))


@query("op11_language_id")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


@query("op12_token_align")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(read(spark, sf_dir, "documents"))


@query("op13_filter_audit", filter_audit.audit_oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
