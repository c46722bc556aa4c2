"""Grouped statistics: regressions, tests, correlations, densities."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from numpy.polynomial.hermite_e import herme2poly
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscreen.functions.special import digamma, normal_two_sided_p, t_two_sided_p, trigamma, trigamma_inverse
from duoscreen.operators.ordered import exact_quantiles, join_null_safe, rank_sums


def trimmed_z(df: DataFrame, value: str, by: str = "sample", percent: float = 2.5, name: str = "zdlfc") -> DataFrame:
    """Z-score against mean and sample sd of the values strictly inside the outer percentiles (A4)."""
    bounds = exact_quantiles(
        df, [by], value, {"_low": percent / 100, "_high": (100 - percent) / 100}
    ).drop("n")
    inside = df.join(F.broadcast(bounds), by).where(
        (F.col(value) > F.col("_low")) & (F.col(value) < F.col("_high"))
    )
    moments = inside.groupBy(by).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    return (
        df.join(F.broadcast(moments), by, "left")
        .withColumn(name, F.try_divide(F.col(value) - F.col("_mu"), F.col("_sd")))
        .drop("_mu", "_sd")
    )


def line_fit(df: DataFrame, by: str, y: str, x: str) -> DataFrame:
    """Least-squares slope and intercept per group."""
    return df.groupBy(by).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept")
    )


def mean_and_sem(df: DataFrame, by: Sequence[str], value: str, mean: str, sem: str) -> DataFrame:
    """Mean and standard error with ddof 1."""
    return df.groupBy(*by).agg(
        F.avg(value).alias(mean), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias(sem)
    )


def column_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every pair of columns, pairwise complete, as rows ``comparison, r``.

    One aggregate over the wide table; replicates are columns, so no self join is needed.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = df.agg(*[F.corr(a, b).alias(f"{b}_vs_{a}") for a, b in pairs])
    return both.unpivot([], [f"{b}_vs_{a}" for a, b in pairs], "comparison", "r")


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a Pearson correlation."""
    df = (n - 2).cast("double")
    return t_two_sided_p(r * F.sqrt(F.try_divide(df, 1 - r * r)), df)


def moments(df: DataFrame, by: Sequence[str], value: str, prefix: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(value).alias(f"{prefix}_n"),
        F.avg(value).alias(f"{prefix}_mean"),
        F.var_samp(value).alias(f"{prefix}_var"),
    )


def welch(pool: str, group: str) -> dict[str, Column]:
    """Welch t and degrees of freedom from two sets of moments.

    NULL when a side has fewer than two values or both variances are zero.
    """
    a = F.try_divide(F.col(f"{pool}_var"), F.col(f"{pool}_n"))
    b = F.try_divide(F.col(f"{group}_var"), F.col(f"{group}_n"))
    usable = (F.col(f"{pool}_n") > 1) & (F.col(f"{group}_n") > 1)
    se2 = F.when(usable, a + b)
    df = F.try_divide(se2 * se2, a * a / (F.col(f"{pool}_n") - 1) + b * b / (F.col(f"{group}_n") - 1))
    t = F.try_divide(F.col(f"{pool}_mean") - F.col(f"{group}_mean"), F.sqrt(se2))
    return {"t": t, "df": F.when(t.isNotNull(), df)}


def with_t_p(df: DataFrame, t: str = "t", dof: str = "df", name: str = "p_val") -> DataFrame:
    """Two-sided p-value column."""
    return df.withColumn(name, t_two_sided_p(F.col(t), F.col(dof)))


def rank_sum_test(df: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Wilcoxon rank-sum test of two columns of a group as two samples: ``n1, n2, u, z, p_val``.

    Normal approximation with tie and continuity correction. NULL where a sample is empty or all values are equal.
    """
    counts = rank_sums(df, keys, first, second)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, apart = n1 + n2, F.col("u") - n1 * n2 / 2
    variance = n1 * n2 / 12 * (n + 1 - F.coalesce(F.try_divide(F.col("ties"), n * (n - 1)), F.lit(0.0)))
    z = F.try_divide(apart - F.signum(apart) * 0.5, F.sqrt(variance))
    tested = counts.select(*keys, "n1", "n2", "u", z.alias("z"))
    return tested.withColumn("p_val", F.when(F.col("z").isNotNull(), F.least(F.lit(1.0), normal_two_sided_p(F.col("z")))))


#: Below this share of its largest value the determinant of the raw sums has lost too many digits.
CLOSE = 1e-6


def quadratic_fit(
    df: DataFrame, by: Sequence[str], x: Column, y: Column, offset: Column, names: tuple[str, str] = ("m0", "m1")
) -> DataFrame:
    """Least squares of ``m0 x^2 + m1 x + offset`` per group, from sums.

    With fewer than two distinct non-zero x the square term is dropped, and with no non-zero x both are. Where the x of a
    group lie so close together that sums of their powers no longer tell them apart, the same fit is taken as the
    line of (y - offset) / x over x with weights x^2, from sums of distances to the group's smallest x.
    """
    rows = df.select(*by, x.alias("_x"), (y - offset).alias("_r"))
    xx, r = F.col("_x"), F.col("_r")
    nonzero = F.nullif(xx, F.lit(0.0))
    sums = rows.groupBy(*by).agg(
        F.sum(xx * xx).alias("_s2"),
        F.sum(xx * xx * xx).alias("_s3"),
        F.sum(xx * xx * xx * xx).alias("_s4"),
        F.sum(xx * r).alias("_t1"),
        F.sum(xx * xx * r).alias("_t2"),
        F.min(nonzero).alias("_min"),
        F.max(nonzero).alias("_max"),
    )
    s2, s3, s4, t1, t2 = (F.col(c) for c in ("_s2", "_s3", "_s4", "_t1", "_t2"))
    det = s4 * s2 - s3 * s3
    full = F.coalesce(F.col("_min") != F.col("_max"), F.lit(False))
    close = full & (det <= CLOSE * s4 * s2)
    u, w, z = xx - F.col("_min"), xx * xx, F.try_divide(r, xx)
    own = join_null_safe(rows.where(xx != 0), sums.where(close).select(*by, "_min"), by)
    near = own.groupBy(*by, "_min").agg(
        F.sum(w).alias("_w"), F.sum(w * u).alias("_u"), F.sum(w * u * u).alias("_uu"), F.sum(w * z).alias("_z"), F.sum(w * u * z).alias("_uz")
    )
    mean_u, mean_z = F.col("_u") / F.col("_w"), F.col("_z") / F.col("_w")
    slope = F.try_divide(F.col("_uz") - mean_u * F.col("_z"), F.col("_uu") - mean_u * F.col("_u"))
    near = near.select(*by, slope.alias("_near0"), (mean_z - slope * (mean_u + F.col("_min"))).alias("_near1"))
    raw0, raw1 = F.try_divide(t2 * s2 - t1 * s3, det), F.try_divide(s4 * t1 - s3 * t2, det)
    m0 = F.when(close, F.col("_near0")).when(full, raw0).otherwise(0.0)
    m1 = F.when(close, F.col("_near1")).when(full, raw1).otherwise(F.coalesce(F.try_divide(t1, s2), F.lit(0.0)))
    other = near.withColumnsRenamed({k: f"_r_{k}" for k in by})
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_r_{k}")), by, F.lit(True))
    return sums.join(other, same, "left").select(*by, m0.alias(names[0]), m1.alias(names[1]))


def histogram(df: DataFrame, value: str, by: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins from the smallest to the largest value of a group."""
    ends = df.groupBy(by).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    width = (F.col("_max") - F.col("_min")) / bins
    place = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_min"), width)), F.lit(0))
    return (
        df.where(F.col(value).isNotNull())
        .join(F.broadcast(ends), by)
        .withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
        .groupBy(by, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.col("_min") + F.col("bin") * width).alias("bin_start"),
            F.max(F.col("_min") + (F.col("bin") + 1) * width).alias("bin_end"),
        )
    )


#: Bins of a bandwidth, terms of the kernel's series in a bin, and bandwidths after which the kernel counts as zero.
KDE_BINS, KDE_TERMS, KDE_REACH = 4, 11, 9.0


def gaussian_kde(
    df: DataFrame, value: str, by: str, low: float = -10.0, high: float = 10.0, points: int = 500
) -> DataFrame:
    """Gaussian kernel density on a fixed grid, with the standard normal curve.

    Bandwidth h is sd * n^(-1/5). A row goes to one bin of width h / 4 and adds powers of its distance from the bin's
    middle; each bin then gives the grid points within nine bandwidths its share by the kernel's Hermite series. So a
    row's cost does not depend on the grid. At a point, the sum of kernels (each 1 at most) is wrong by at most 3e-13 of the
    rows: 1e-13 by the terms left out (|u|^11 / sqrt(11!) for |u| <= 1/8), the rest by the kernel beyond its reach.
    Groups, which must be few, have no density without two different values; NULL and NaN values are left out.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    spread = known.groupBy(by).agg(F.stddev_samp(value).alias("_sd"), F.count(value).alias("_n"))
    width = F.nullif(F.col("_sd"), F.lit(0.0)) * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    spread = spread.select(by, "_n", width.alias("_h"))
    step = (high - low) / (points - 1)
    place = F.col(value) / F.col("_h") * KDE_BINS
    near = F.col(value).between(low - (KDE_REACH + 1) * F.col("_h"), high + (KDE_REACH + 1) * F.col("_h"))
    u = (place - F.col("_bin") - 0.5) / KDE_BINS
    powers = [F.lit(1.0)]
    for _ in range(KDE_TERMS - 1):
        powers.append(powers[-1] * u)
    bins = (
        join_null_safe(known, F.broadcast(spread.where(F.col("_h").isNotNull())), [by])
        .where(near)
        .withColumn("_bin", F.floor(place))
        .groupBy(by, "_bin")
        .agg(F.max("_h").alias("_h"), *[F.sum(p).alias(f"_m{k}") for k, p in enumerate(powers)])
        .withColumn("_centre", (F.col("_bin") + 0.5) / KDE_BINS)
    )
    first = F.greatest(F.lit(0), F.ceil(((F.col("_centre") - KDE_REACH) * F.col("_h") - low) / step)).cast("int")
    last = F.least(F.lit(points - 1), F.floor(((F.col("_centre") + KDE_REACH) * F.col("_h") - low) / step)).cast("int")
    t = (F.lit(low) + F.col("point") * step) / F.col("_h") - F.col("_centre")
    series = F.lit(0.0)
    for k in range(KDE_TERMS):
        hermite = F.lit(0.0)
        for c in reversed(herme2poly([0.0] * k + [1.0]).tolist()):
            hermite = hermite * F.col("_t") + c
        series = series + F.col(f"_m{k}") * hermite / float(math.factorial(k))
    sums = (
        bins.where(first <= last)
        .withColumn("point", F.explode(F.sequence(first, last)))
        .withColumn("_t", t)
        .groupBy(by, "point")
        .agg(F.sum(F.exp(-F.col("_t") * F.col("_t") / 2) * series).alias("_sum"))
    )
    grid = spread.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.lit(low) + F.col("point") * step)
    same = grid[by].eqNullSafe(sums[by]) & (grid["point"] == sums["point"])
    root = math.sqrt(2 * math.pi)
    density = F.coalesce(F.greatest(sums["_sum"], F.lit(0.0)), F.when(F.col("_h").isNotNull(), F.lit(0.0))) / (F.col("_n") * F.col("_h") * root)
    return grid.join(sums, same, "left").select(
        grid[by], grid["point"], "x", density.alias("density"), (F.exp(-F.col("x") * F.col("x") / 2) / root).alias("normal")
    )


def moderated_variance(df: DataFrame, by: str, var: str, dof: str) -> DataFrame:
    """Prior degrees of freedom and variance of a scaled inverse chi-square, one row per group.

    Moment fit on the log variances. ``d0`` is NULL (infinite) when they vary no more than sampling explains.
    """
    half = F.col(dof) / 2
    usable = df.where((F.col(var) > 0) & (F.col(dof) > 0))
    centred = usable.select(
        by,
        (F.log(var) - digamma(half) + F.log(half)).alias("_e"),
        trigamma(half).alias("_tri"),
    )
    fit = centred.groupBy(by).agg(
        F.avg("_e").alias("_mean"), (F.var_samp("_e") - F.avg("_tri")).alias("_excess")
    )
    d0 = F.when(F.col("_excess") > 0, 2 * trigamma_inverse(F.col("_excess")))
    fit = fit.withColumn("d0", d0)
    half0 = F.col("d0") / 2
    s02 = F.when(F.col("d0").isNull(), F.exp("_mean")).otherwise(
        F.exp(F.col("_mean") + digamma(half0) - F.log(half0))
    )
    return fit.select(by, "d0", s02.alias("s02"))


def moderated_t(df: DataFrame, by: str, mean: str, var: str, n: str) -> DataFrame:
    """Moderated one-sample t-test per row of moments, variance shrunk towards its group's prior."""
    dof = F.col(n) - 1
    tested = df.withColumn("_dof", dof.cast("double"))
    prior = moderated_variance(tested, by, var, "_dof")
    pooled = tested.groupBy(by).agg(F.sum(F.when(F.col(var).isNotNull(), F.col("_dof"))).alias("_pooled"))
    joined = tested.join(F.broadcast(prior), by, "left").join(F.broadcast(pooled), by, "left")
    s2 = F.coalesce(F.col(var), F.lit(0.0))
    post = F.when(F.col("d0").isNull(), F.col("s02")).otherwise(
        (F.col("d0") * F.col("s02") + F.col("_dof") * s2) / (F.col("d0") + F.col("_dof"))
    )
    total = F.when(F.col("d0").isNull(), F.col("_pooled")).otherwise(
        F.least(F.col("d0") + F.col("_dof"), F.col("_pooled"))
    )
    return with_t_p(
        joined.withColumn("t", F.try_divide(F.col(mean), F.sqrt(F.try_divide(post, F.col(n))))).withColumn("df", total)
    ).drop("_dof", "_pooled")
