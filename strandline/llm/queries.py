"""The queries opN_<name> over the driver's tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import ctw, fingerprints, language_id, line_dedup, mixing, near_dedup, packing, quality, secrets, substring_dedup


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(C.read(spark, sf_dir, "documents"), digests=True)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(C.read(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(C.read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(C.read(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(C.read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(C.read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_spans(C.read(spark, sf_dir, "documents"), report=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.read(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(C.read(spark, sf_dir, "documents"))


ALL = (op1_line_dedup, op2_lm_score, op3_secret_scan, op4_mixing, op5_near_dedup, op6_language_id, op7_substring_dedup, op8_quality_rules, op9_packing, op10_fingerprints)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op5_near_dedup": near_dedup.oracle(), "op6_language_id": language_id.oracle(), "op8_quality_rules": quality.oracle()}
