"""Means of several columns of one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_mean(columns: Sequence[str | Column]) -> Column:
    """Mean of the present values of a row; NULL if there are none."""
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    if len(values) == 1:
        return values[0]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    present = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    return F.try_divide(total, present)


def row_mean_complete(columns: Sequence[str]) -> Column:
    """Mean of a row, NULL unless all values are present."""
    return sum((F.col(c) for c in columns), F.lit(0.0)) / len(columns)
