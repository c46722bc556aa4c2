"""Reshaping and combining score tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def widen(
    df: DataFrame, keys: Sequence[str], names_from: str, names: Sequence[str], values: dict[str, str]
) -> DataFrame:
    """Long to wide with known column names ``<value>_<name>`` (R6). One aggregate, no pre-pass for the names."""
    cells = [
        F.max(F.when(F.col(names_from) == n, F.col(v))).alias(f"{out}_{n}" if out else n)
        for out, v in values.items()
        for n in names
    ]
    return df.groupBy(*keys).agg(*cells)


def transpose(df: DataFrame, row: str, columns: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """Matrix with row labels to sparse ``(column label, row label, value)`` rows."""
    return df.unpivot([row], list(columns), names[0], names[1])


def swap_keys(df: DataFrame, a: str, b: str) -> DataFrame:
    """Transpose of a sparse matrix: exchange its two key columns."""
    return df.select(
        *[F.col(b).alias(a) if c == a else F.col(a).alias(b) if c == b else F.col(c) for c in df.columns]
    )


def stack_scores(scores: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Score tables of several cell lines as one long table."""
    parts = [df.select(key, F.lit(name).alias("sample"), F.col(value).alias(value)) for name, df in scores.items()]
    return reduce(DataFrame.unionByName, parts)


def full_outer(scores: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One column per cell line over the union of pairs."""
    parts = [df.select(key, F.col(value).alias(name)) for name, df in scores.items()]
    return reduce(lambda a, b: a.join(b, key, "full"), parts)


def distinct_values(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Distinct values over several columns."""
    return df.select(F.explode(F.array(*columns)).alias(name)).distinct()


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in an explicit order (W3), as an aggregate with partial results, not a sort per key."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.min(ranked).alias("_first")).select(*keys, *[f"_first.{c}" for c in rest])


def matrix_lookup(
    pairs: DataFrame, scores: DataFrame, a: str, b: str, value: str, groups: Sequence[str] = ()
) -> DataFrame:
    """Mean of a sparse matrix and its transpose at ``(a, b)``; an absent cell counts as zero.

    groups: columns that tell several matrices in one table apart.
    """
    keys = [*groups, a, b]
    direct = scores.select(*keys, F.col(value).alias("_ab"))
    mirrored = swap_keys(scores.select(*keys, F.col(value).alias("_ba")), a, b)
    both = pairs.join(direct, keys, "left").join(mirrored, keys, "left")
    mean = (F.coalesce("_ab", F.lit(0.0)) + F.coalesce("_ba", F.lit(0.0))) / 2
    return both.withColumn(value, mean).drop("_ab", "_ba")
