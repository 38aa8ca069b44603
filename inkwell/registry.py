"""Every query of the engine by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell import oracle, queries

FLAGSHIP = "list_artifacts"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f for name, f in vars(queries).items() if callable(f) and not name.startswith("_") and getattr(f, "__module__", "") == queries.__name__
}

ORACLE_SQL: dict[str, str] = {k: v for k, v in oracle.SQL.items() if k in QUERIES}
