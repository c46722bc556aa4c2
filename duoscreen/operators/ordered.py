"""Exact order statistics and rank-based corrections that never put a whole group on one task.

The built-in exact ``percentile`` keeps all values of a group in one buffer, and a window ordered inside a
group sorts the group on one task. Both are fine for groups of bounded size and wrong for a group that holds a
third of a huge table. The functions here work on *cells*: a fixed, data-independent, order-preserving cut of
the number line. Rows are counted per cell, with partial counts before the shuffle, and the counts are summed
along the cells of a group, whose number has a fixed upper bound. Equal values of a group are one row from the first shuffle
on, and only the rows of the cells that hold a wanted rank are sorted.

Where every row needs its rank, the rows are written in ranges of the value instead, and ranks are counted range by range.

``log2`` in the JVM is documented as semi-monotonic, and ``1 + x``, ``x * 2^k``, ``abs`` and ``floor`` are monotone
in floating point, so a larger value never falls into a lower cell and the results are exact.

A cell of one value that holds a wanted rank gives its value at once. A group whose values lie close together may fill
one cell: the other cells that hold a wanted rank are cut once more, evenly between their smallest and largest value. There is one way for groups of all sizes and for any number of groups.

NULL keys form groups like any other key; NULL and NaN values are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscreen.session import stage

_CELLS_PER_OCTAVE = 2**14
_NEAR_ZERO = 2.0**20
_CUTS_PER_CELL = 2**12


def value_cell(value: Column) -> Column:
    """Order-preserving cell number of a double: 16,384 cells per doubling, linear within 2^-20 of zero."""
    octaves = F.signum(value) * F.log2(1 + F.abs(value) * F.lit(_NEAR_ZERO))
    return F.floor(octaves * F.lit(float(_CELLS_PER_OCTAVE))).cast("long")


def _target_ranks(probs: Sequence[float], total: Column) -> list[tuple[Column, Column, Column]]:
    """Zero-based lower rank, upper rank and interpolation weight of each probability."""
    out = []
    for p in probs:
        position = (total - 1) * F.lit(float(p))
        out.append((F.floor(position).cast("long"), F.ceil(position).cast("long"), position - F.floor(position)))
    return out


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi join in which NULL keys match each other; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, same).drop(*[f"_r_{k}" for k in keys])


def _holding(cells: DataFrame, part: Sequence[str], cell: str, ranks: Column, before: Column) -> DataFrame:
    """The cells of each part that hold one of the ranks: ``_start`` rows lie before a cell, ``_ranks`` are in it."""
    along = Window.partitionBy(*part).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cells.withColumn("_end", before + F.sum("_n").over(along))
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_end"))))
        .where(F.size("_ranks") > 0)
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, for any number of groups of any size.

    One row per group with one column per entry of ``quantiles`` and the group size ``n``.
    """
    keys = list(keys)
    probs = list(quantiles.values())
    number = F.col(value).cast("double")
    counted = (
        df.where(number.isNotNull() & ~F.isnan(number))
        .select(*keys, number.alias("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_cell", value_cell(F.col("_v")))
    )
    cells = (
        counted.groupBy(*keys, "_cell")
        .agg(F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys)))
    )
    ranks = F.array_distinct(F.array(*[r for t in _target_ranks(probs, F.col("_total")) for r in t[:2]]))
    picked = _holding(cells, keys, "_cell", ranks, F.lit(0))
    alone, crowded = picked.where(F.col("_low") == F.col("_high")), picked.where(F.col("_low") != F.col("_high"))
    share = F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low"))
    inside = join_null_safe(
        counted, crowded.select(*keys, "_cell", "_start", "_total", "_ranks", "_low", "_high"), [*keys, "_cell"]
    ).withColumn("_cut", F.coalesce(F.floor(share * F.lit(float(_CUTS_PER_CELL))), F.lit(0)).cast("long"))
    cuts = inside.groupBy(*keys, "_cell", "_cut").agg(
        F.sum("_n").alias("_n"), *[F.any_value(c).alias(c) for c in ("_start", "_total", "_ranks")]
    )
    cut_picked = _holding(cuts.withColumnRenamed("_start", "_before"), [*keys, "_cell"], "_cut", F.col("_ranks"), F.col("_before"))
    within = join_null_safe(
        inside.select(*keys, "_cell", "_cut", "_v", "_n"),
        cut_picked.select(*keys, "_cell", "_cut", "_start", "_total", "_ranks"),
        [*keys, "_cell", "_cut"],
    )
    last = Window.partitionBy(*keys, "_cell", "_cut").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        within.withColumn("_end", F.col("_start") + F.sum("_n").over(last))
        .withColumn("_begin", F.col("_end") - F.col("_n"))
        .withColumn("_rank", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_begin")) & (r < F.col("_end")))))
    )
    found = [*keys, "_total", "_rank", "_v"]
    hits = alone.withColumn("_rank", F.explode("_ranks")).withColumn("_v", F.col("_low")).select(*found).unionByName(hits.select(*found))
    aggs = [F.max("_total").alias("n")]
    for name, (low, high, _) in zip(quantiles, _target_ranks(probs, F.col("_total"))):
        aggs.append(F.max(F.when(F.col("_rank") == low, F.col("_v"))).alias(f"_low_{name}"))
        aggs.append(F.max(F.when(F.col("_rank") == high, F.col("_v"))).alias(f"_high_{name}"))
    found = hits.groupBy(*keys).agg(*aggs)
    out = []
    for name, (_, _, weight) in zip(quantiles, _target_ranks(probs, F.col("n"))):
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        out.append((low + (high - low) * weight).alias(name))
    return found.select(*keys, *out, "n")


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}).drop("n")


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` written in ranges of ``order`` within ``keys``, so that the order of rows can be counted range by range.

    Adds ``_key``, the keys as one value that is never NULL, and ``_range``: all rows of a key in a lower range come before those in
    a higher one. A range is as large as any partition, whatever a key holds, if ``order`` tells all rows apart. The
    ranges are written, so a lost executor can't deal them out anew.
    """
    ranged = df.withColumn("_key", F.struct(*keys)).repartitionByRange(*keys, *order)
    return stage(ranged.withColumn("_range", F.spark_partition_id()), "ranges")


def _along():
    return Window.partitionBy("_key").orderBy("_range")


def bh_fdr(df: DataFrame, keys: Sequence[str], p: str, name: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values per group; rows with NULL p get NULL and do not count.

    A group is all pairs of a replicate, so its rows are ranked in ranges: the running count and the reverse running
    minimum are taken along the ranges of a group first, and inside single ranges after that. Rows of equal p get the
    ranks of their places; the minimum over later rows gives all of them the value of the last.
    """
    numbered = stage(df.withColumn("_row", F.monotonically_increasing_id()), "p-values")
    given = in_ranges(numbered.where(F.col(p).isNotNull()), keys, [p, "_row"])
    part = ["_key", "_range"]
    starts = (
        given.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(_along().rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .withColumn("_total", F.sum("_n").over(Window.partitionBy("_key")))
        .select(*part, "_start", "_total")
    )
    inside = Window.partitionBy(*part).orderBy(p, "_row")
    ranked = given.join(starts, part).withColumn(
        "_q", F.col(p) * F.col("_total") / (F.col("_start") + F.row_number().over(inside))
    )
    later = (
        ranked.groupBy(*part)
        .agg(F.min("_q").alias("_q"))
        .select(*part, F.min("_q").over(_along().rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    )
    here = F.min("_q").over(inside.rowsBetween(0, Window.unboundedFollowing))
    adjusted = ranked.join(later, part).withColumn(name, F.least(F.lit(1.0), here, "_later"))
    left = numbered.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double"))
    return adjusted.select(*df.columns, name).unionByName(left.select(*df.columns, name))


def rank_sums(df: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Wilcoxon rank-sum counts of two columns of a group, taken as two samples.

    Per group: ``n1`` and ``n2`` values, ``u`` (pairs in which the first is larger, a tie counting half) and ``ties``, the sum of
    n^3 - n over groups of equal values. NULL and NaN values are left out one by one. Midranks come from running counts
    of distinct values along written ranges, so no task sorts a group and no pair is built.
    """
    sides = F.array(
        F.struct(F.col(first).cast("double").alias("_v"), F.lit(1).alias("_a")),
        F.struct(F.col(second).cast("double").alias("_v"), F.lit(0).alias("_a")),
    )
    counted = (
        df.select(*keys, F.inline(sides))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v")
        .agg(F.sum("_a").alias("_n1"), F.count(F.lit(1)).alias("_n"))
    )
    inside = Window.partitionBy("_key", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("_n").cast("double")
    local = (
        in_ranges(counted, keys, ["_v"])
        .withColumn("_rank", F.sum("_n").over(inside) - (n - 1) / 2)
        .groupBy("_key", "_range")
        .agg(
            F.sum("_n").alias("_n"),
            F.sum("_n1").alias("_n1"),
            F.sum(F.col("_n1") * F.col("_rank")).alias("_r"),
            F.sum(n * n * n - n).alias("_ties"),
        )
        .withColumn("_start", F.sum("_n").over(_along().rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    )
    totals = local.groupBy("_key").agg(
        F.sum("_n1").alias("n1"),
        F.sum(F.col("_n") - F.col("_n1")).alias("n2"),
        F.sum(F.col("_r") + F.col("_start") * F.col("_n1")).alias("_rank_sum"),
        F.sum("_ties").alias("ties"),
    )
    smallest = F.col("n1") * (F.col("n1").cast("double") + 1) / 2
    return totals.select("_key.*", "n1", "n2", (F.col("_rank_sum") - smallest).alias("u"), "ties")
