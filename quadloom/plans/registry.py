"""All graph queries by name, with their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadloom.sources.graphs import EVENTS, STAR, in_duckdb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = ["lookups", "matching", "closures", "inference", "changes", "texts", "ranking", "sessions", "files", "dialogue", "references"]


def query(name: str, sql: str | None = None, graph: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql may use the tables, and the graph's tables where a graph ('star' or 'events') is named."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ctes = in_duckdb({"star": STAR, "events": EVENTS}[graph]).strip() if graph else ""
            body = sql.strip()
            if ctes and body.upper().startswith("WITH"):
                body = body[4:].strip()
                body = body[9:].strip() if body.upper().startswith("RECURSIVE") else body
                SQL[name] = f"WITH RECURSIVE {ctes}, {body}"
            else:
                SQL[name] = f"WITH RECURSIVE {ctes} {body}" if ctes else body
        return f

    return put


def loaded() -> None:
    for m in MODULES:
        importlib.import_module(f"quadloom.plans.{m}")


def queries() -> dict[str, Query]:
    loaded()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    loaded()
    return dict(SQL)
