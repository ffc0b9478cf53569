"""The queries of problems 8 to 10 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import leakage, tokenizer, toxicity
from tidegauge.session import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.offsets(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leakage.reparameterised(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.found(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(table(spark, d, "documents"), table(spark, d, "review_labels"))


QUERIES = {f.__name__: f for f in (p8_ids, p8_offsets, p9_found, p9_reparameterised, p10_found, p10_scores, p10_rates)}
ORACLES: dict[str, str] = {}
