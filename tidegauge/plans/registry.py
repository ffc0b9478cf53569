"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.plans import core_queries, data_queries, service_queries

QUERIES = {**core_queries.QUERIES, **service_queries.QUERIES, **data_queries.QUERIES}
ORACLES = {**core_queries.ORACLES, **service_queries.ORACLES, **data_queries.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk index of the market arms."""
    return QUERIES["risk_index"](spark, sf_dir)
