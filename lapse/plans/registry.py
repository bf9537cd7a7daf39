"""Registry of named queries and their DuckDB oracle SQL.

A query is a callable ``(spark, sf_dir) -> DataFrame``. Its oracle is ANSI
SQL over the driver's base tables; role views are inlined as ``r_*`` CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lapse.sources.roles import ROLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its oracle (None = rows-only check)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def with_ctes(ctes: list[tuple[str, str]], final: str, roles: list[str] = ()) -> str:
    """``WITH`` clause of the named role views plus own CTEs, then ``final``."""
    parts = [f"{r} AS ({ROLE_SQL[r]})" for r in roles]
    parts += [f"{n} AS ({q})" for n, q in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" + final) if parts else final
