"""The engine's queries by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import star_queries, workspace_queries

QUERIES = star_queries.QUERIES | workspace_queries.QUERIES
ORACLE_SQL = star_queries.ORACLE_SQL | workspace_queries.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_queries.impact_callers_d3(spark, sf_dir)
