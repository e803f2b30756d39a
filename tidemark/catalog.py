"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import artifact_queries, fleet_queries, label_queries, measure_queries, probe_queries, protocol_queries, study_queries

ALL = label_queries.QUERIES | fleet_queries.QUERIES | study_queries.QUERIES | measure_queries.QUERIES | protocol_queries.QUERIES | probe_queries.QUERIES | artifact_queries.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable and releasable tasks of every analyst."""
    return fleet_queries.fleet_contribute(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
