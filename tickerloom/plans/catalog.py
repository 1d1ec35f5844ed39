"""The registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(column: str | Column, digits: int = 6) -> Column:
    """Double rounded half away from zero in binary arithmetic, as the SQL twin rounds."""
    col = (F.col(f"`{column}`") if isinstance(column, str) else column).cast("double")
    scale = F.lit(10.0**digits)
    out = F.signum(col) * F.floor(F.abs(col) * scale + 0.5) / scale
    return out.alias(column) if isinstance(column, str) else out


def load_all() -> None:
    """Import every query module once."""
    from tickerloom.plans import (  # noqa: F401
        macro_queries,
        market_queries,
        quality_queries,
        risk_queries,
        rule_queries,
        text_queries,
        evidence_queries,
        investor_queries,
        forecast_queries,
        ingest_queries,
        storage_queries,
        stream_queries,
    )
