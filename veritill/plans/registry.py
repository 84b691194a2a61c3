"""Every query of the engine by name, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of (spark, sf_dir), with its SQL where SQL can express it."""

    def take(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return take


from . import queries_audits, queries_contracts, queries_joins, queries_metrics, queries_rules, queries_scalar, queries_sources, queries_state, queries_streams, queries_windows  # noqa: E402,F401
