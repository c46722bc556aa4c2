"""Local regression at fixed knots, from sums over single bins.

The tricube weight (1 - |u|^3)^3 of a row at a knot is a polynomial of degree nine in the row's place between two
neighbouring knots, as long as the window is a whole number of knot distances wide. So the weighted sums of every knot
follow exactly from power sums within bins: each row goes to one bin, whatever the number of knots or the width of the
window, and one aggregate holds all that the fit needs.
"""

from __future__ import annotations

import numpy as np
from numpy.polynomial import polynomial as P
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscreen.operators.ordered import join_null_safe

#: A window whose weighted variance of places, in squares of its half width, is no larger has no slope of its own.
FLAT = 1e-9


def _powers(v: Column, n: int) -> list[Column]:
    out = [F.lit(1.0)]
    for _ in range(n):
        out.append(out[-1] * v)
    return out


def _window(offset: int, reach: int) -> list[list[float]]:
    """Coefficients in v of w, w u and w u^2 for u = (offset + v) / reach, 0 <= v <= 1, w the tricube weight of u."""
    u = np.array([offset, 1.0]) / reach
    side = -1.0 if offset < 0 else 1.0
    weight = P.polypow(P.polysub([1.0], side * P.polypow(u, 3)), 3)
    return [P.polymul(weight, P.polypow(u, a)).tolist() for a in range(3)]


def _dot(coefficients: str, sums: str) -> Column:
    products = F.zip_with(coefficients, sums, lambda c, m: F.coalesce(c * m, F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def local_trend(
    df: DataFrame, by: str, x: str, y: str, name: str = "trend", knots: int = 41, reach: int = 12
) -> DataFrame:
    """``df`` with the local linear regression of ``y`` on ``x`` within each group, read at the row's own ``x``.

    The knots stand evenly from the smallest to the largest x of a group, and a knot's line is fitted to the rows within
    ``reach`` knot distances by tricube weights; between knots the fit is interpolated, so a linear y is its own trend.
    Where a window holds a single x the trend is the weighted mean. Rows without x get no trend; rows without x or y take
    no part in the fit. There is one row of knots for each group, which must be few (cell lines or replicates). ``reach`` is
    at least 2, so that a row weighs at the knots on both sides of it.
    """
    if reach < 2:
        raise ValueError("reach must be 2 or more")
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = full.groupBy(by).agg(F.min(x).alias("_low"), ((F.max(x) - F.min(x)) / (knots - 1)).alias("_step"))
    at = F.coalesce(F.try_divide(F.col(x) - F.col("_low"), F.col("_step")), F.lit(0.0))
    bin_ = F.greatest(F.lit(0), F.least(F.floor(at), F.lit(knots - 2))).cast("int")

    def placed(rows: DataFrame) -> DataFrame:
        near = join_null_safe(rows, F.broadcast(ends), [by])
        return near.withColumn("_bin", bin_).withColumn("_v", at - F.col("_bin")).drop("_low", "_step")

    powers = _powers(F.col("_v"), 11)
    sums = (
        placed(full)
        .groupBy(by, "_bin")
        .agg(F.array(*[F.sum(p) for p in powers]).alias("_m"), F.array(*[F.sum(F.col(y) * p) for p in powers[:11]]).alias("_r"))
    )
    table = [(o, *_window(o, reach)) for o in range(-reach, reach)]
    offsets = df.sparkSession.createDataFrame(table, "_o int, _c0 array<double>, _c1 array<double>, _c2 array<double>")
    met = (
        sums.crossJoin(F.broadcast(offsets))  # 2 * reach rows for each bin, and a group has knots - 1 bins
        .withColumn("_knot", F.col("_bin") - F.col("_o"))
        .where(F.col("_knot").between(0, knots - 1))
        .groupBy(by, "_knot")
        .agg(
            *[F.sum(_dot(f"_c{a}", "_m")).alias(f"_s{a}") for a in range(3)],
            *[F.sum(_dot(f"_c{a}", "_r")).alias(f"_t{a}") for a in range(2)],
        )
        .where(F.col("_s0") > 0)
    )
    u, mean = F.col("_s1") / F.col("_s0"), F.col("_t0") / F.col("_s0")
    variance = F.col("_s2") / F.col("_s0") - u * u
    slope = F.when(variance > FLAT, (F.col("_t1") / F.col("_s0") - u * mean) / variance).otherwise(0.0)
    lines = met.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("_knot", (mean - slope * u).alias("f")))).alias("_lines"))
    read = join_null_safe(placed(df.where(F.col(x).isNotNull())), F.broadcast(lines), [by])
    ahead = F.when(F.col("_v") == 0, F.lit(0.0)).otherwise(F.col("_v") * (F.try_element_at("_lines", F.col("_bin") + 1) - F.try_element_at("_lines", "_bin")))
    known = read.withColumn(name, F.try_element_at("_lines", "_bin") + ahead).drop("_bin", "_v", "_lines")
    return known.unionByName(df.where(F.col(x).isNull()).withColumn(name, F.lit(None).cast("double")))
