"""Registry of named queries and their SQL twins.

A query is a Spark callable plus, where SQL can say it, a DuckDB statement over the same tables. Doubles are
rounded on both sides, because engines add in different orders.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 6


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}
CTES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles; values that round to zero become plain zero (never negative zero)."""
    half = 0.5 * 10**-DIGITS
    return df.select(
        *[
            F.when(F.abs(F.col(f"`{f.name}`")) < half, F.lit(0.0))
            .otherwise(F.round(F.col(f"`{f.name}`"), DIGITS))
            .alias(f.name)
            if f.dataType.typeName() == "double"
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def cte(name: str, sql: str) -> None:
    """Name a subquery that other statements may use; its own inputs are found by name."""
    CTES[name] = sql


def _needed(sql: str, found: list[str]) -> None:
    for word in re.findall(r"(?:FROM|JOIN)\s+([a-z_][a-z0-9_]*)", sql):
        if word in CTES and word not in found:
            _needed(CTES[word], found)
            if word not in found:
                found.append(word)


def with_ctes(sql: str) -> str:
    found: list[str] = []
    _needed(sql, found)
    body = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name]})" for name in found)
    return f"WITH {body}\n{sql}" if found else sql


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    """Register a query. ``doubles`` names the columns of the statement to round."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        full = None
        if sql is not None:
            half = f"{0.5 * 10**-DIGITS:.10f}"
            changes = ", ".join(
                f'CASE WHEN abs("{c}") < {half} THEN 0.0::DOUBLE ELSE round("{c}", {DIGITS}) END AS "{c}"' for c in doubles
            )
            outer = f"SELECT * REPLACE ({changes}) FROM ({sql})" if doubles else sql
            full = with_ctes(outer)
        QUERIES[name] = Query(lambda spark, sf_dir: rounded(fn(spark, sf_dir)), full)
        return fn

    return wrap
