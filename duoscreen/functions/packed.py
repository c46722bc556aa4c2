"""Packed replicate lists: counts as ``n;n;n`` text with the names in a parallel column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(columns: Sequence[str], sep: str = ";") -> Column:
    """Join count columns to one text value (P12); a missing count is written as ``nan``."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])


def unpack(packed: Column, sep: str = ";") -> Column:
    """Text list to ``array<double>``; anything that is not a number becomes NULL."""
    return F.transform(F.split(packed, sep), lambda s: F.nanvl(s.try_cast("double"), F.lit(None).cast("double")))


def unpack_columns(df: DataFrame, packed: str, names: Sequence[str], fill: float | None = None) -> DataFrame:
    """One column per replicate (P13); ``fill`` replaces missing values."""
    values = unpack(F.col(packed))
    cols = {}
    for i, name in enumerate(names):
        value = F.get(values, F.lit(i))
        cols[name] = F.coalesce(value, F.lit(float(fill))) if fill is not None else value
    return df.withColumns(cols)


def select_conditions(counts: Column, names: Column, wanted: Column) -> Column:
    """Values of a count list whose condition name is wanted; positions past the end of the list are skipped."""
    paired = F.arrays_zip(F.slice(names, F.lit(1), F.size(counts)).alias("name"), counts.alias("value"))
    kept = F.filter(paired, lambda x: F.array_contains(wanted, x["name"]))
    return F.transform(kept, lambda x: x["value"])
