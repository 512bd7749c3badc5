"""The registry of saved queries: each is a function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with the DuckDB SQL it must equal."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


from edgewright.plans import audit_queries, calibration_queries, counted_queries, feature_queries, graph_queries, grid_queries, inference_queries, metric_queries, model_queries, similarity_queries, split_queries, study_queries  # noqa: E402, F401
