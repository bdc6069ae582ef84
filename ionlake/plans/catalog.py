"""Registered queries of the measurement engine with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionlake.plans import matrix_queries, more_queries, raw_queries

QUERIES = matrix_queries.QUERIES | raw_queries.QUERIES | more_queries.QUERIES
ORACLES = matrix_queries.ORACLES | raw_queries.ORACLES | more_queries.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that pass the coefficient-of-variation filter in some region."""
    return QUERIES["cv_filter_grouped"](spark, sf_dir)
