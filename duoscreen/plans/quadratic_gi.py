"""Quadratic-fit genetic interaction score averaged over orientations.

The guide-by-guide score matrix is never built. Every fit is a set of sums per query guide, the residuals stay on
their constructs, and the matrix mean with its transpose is a sum over the two rows of a guide pair.
A guide pair may be repeated: every row takes part in the fits, and the last row's scores stand for the pair.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duoscreen.functions.labels import pair_key, same_gene_is_dual, target_arity
from duoscreen.operators.filters import mask_low_count_guides
from duoscreen.operators.normalize import (
    average_sides,
    fitness_fold_change,
    orientation_average,
    row_mean_complete,
    to_long,
)
from duoscreen.operators.stats import mean_and_sem, quadratic_fit
from duoscreen.screen import CONSTRUCT, GENE1, GENE2, GUIDE1, GUIDE2, Layout
from duoscreen.session import stage


def one_change(screen: DataFrame, layout: Layout) -> tuple[DataFrame, Layout]:
    """Counts with zero for missing ones, and per cell line as many late as early columns.

    A cell line with equal numbers keeps its replicates, compared pair by pair. Otherwise the counts of each side are
    averaged first, so that the cell line has one fold change.
    """
    df = screen.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in [*layout.late, *layout.early]})
    samples, t0 = {}, {}
    for sample, late in layout.samples.items():
        early = layout.early_of(sample)
        if len(early) == len(late):
            samples[sample], t0[sample] = list(late), early
        else:
            names = (f"{sample}_t0", f"{sample}_tend")
            df = average_sides(df, early, late, names)
            samples[sample], t0[sample] = [names[1]], [names[0]]
    return df, Layout(samples, t0, layout.control)


def construct_phenotypes(
    screen: DataFrame, layout: Layout, threshold: float = 35.0, pseudo: float = 10.0
) -> DataFrame:
    """Phenotype of each construct by cell line, averaged over orientations: ``(construct, arity, sample, fc)``."""
    df, layout = one_change(screen, layout)
    df = stage(df.select(*CONSTRUCT, *layout.late, *layout.early), "counts")
    if threshold > 0:
        df = stage(mask_low_count_guides(df, layout.late, threshold), "masked-screen")
    df = df.withColumn("arity", same_gene_is_dual(target_arity(layout.control)))
    df = fitness_fold_change(df, layout, F.col("arity") == "Control", pseudo)
    means = {s: row_mean_complete(cols) for s, cols in layout.samples.items()}
    df = stage(df.withColumns(means).select(*CONSTRUCT, "arity", *layout.samples), "fitness")
    df = orientation_average(df, list(layout.samples))
    averaged = df.select(*CONSTRUCT, "arity", *[F.col(f"{s}_abba").alias(s) for s in layout.samples])
    return to_long(averaged, [*CONSTRUCT, "arity"], list(layout.samples), "sample", "fc").where(
        F.col("fc").isNotNull()
    )


def guide_phenotypes(long: DataFrame, control: str) -> DataFrame:
    """Single phenotype of each guide at each position, over constructs with a control (A5)."""
    rest = long.where(F.col("arity") != "Dual")

    def side(position: int, guide: str, partner: str) -> DataFrame:
        return (
            rest.where(F.col(partner) == control)
            .groupBy("sample", F.col(guide).alias("guide"))
            .agg(F.avg("fc").alias("phenotype"))
            .withColumn("position", F.lit(position))
        )

    return side(1, GUIDE1, GENE2).unionByName(side(2, GUIDE2, GENE1))


def attach_phenotypes(long: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Phenotypes of both guides of a construct; a guide without one gets zero."""
    for position, guide, name in ((1, GUIDE1, "pheno1"), (2, GUIDE2, "pheno2")):
        side = phenotypes.where(F.col("position") == position).select(
            "sample", F.col("guide").alias(guide), F.col("phenotype").alias(name)
        )
        long = long.join(side, ["sample", guide], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return long


# The two fits: name, query guide, gene on the other position, its phenotype (x) and the query's own (offset).
FITS = (
    ("score_a", GUIDE2, GENE1, "pheno1", "pheno2"),
    ("score_b", GUIDE1, GENE2, "pheno2", "pheno1"),
)


def query_residuals(df: DataFrame) -> DataFrame:
    """Residual of each construct from the curve of its guide at position 2 and at position 1.

    A query guide may be in a large part of all constructs: fits are plain sums with partial aggregation, and the
    joins back have one row per guide on the other side, which skew handling can split.
    """
    out = df
    for name, query, _, x, offset in FITS:
        fit = quadratic_fit(df, ["sample", query], F.col(x), F.col("fc"), F.col(offset))
        curve = F.col("m0") * F.col(x) * F.col(x) + F.col("m1") * F.col(x) + F.col(offset)
        out = out.join(fit, ["sample", query]).withColumn(name, F.col("fc") - curve).drop("m0", "m1")
    return out


def in_control_units(residuals: DataFrame, control: str) -> DataFrame:
    """Residuals over the population sd of the query guide's control residuals, where there are any."""
    out = residuals
    for name, query, partner, _, _ in FITS:
        spread = (
            residuals.where(F.col(partner) == control).groupBy("sample", query).agg(F.stddev_pop(name).alias("_sd"))
        )
        unit = F.coalesce(F.nullif(F.col("_sd"), F.lit(0.0)), F.lit(1.0))
        out = out.join(spread, ["sample", query], "left").withColumn(name, F.col(name) / unit).drop("_sd")
    return out


def toward_zero(value):
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("double")


def construct_gi(long: DataFrame, control: str, truncate_first: bool = True, order: Sequence[str] = ()) -> DataFrame:
    """Score of every construct: residuals of both fits, averaged over the guide pair's two orientations.

    A construct present in one orientation only keeps half of its weight. ``truncate_first`` cuts the residuals of
    the first fit to whole numbers. Of rows that repeat a guide pair, the last by ``order`` (columns of ``long``; by
    default the genes and the fold change) gives all of them its scores.
    """
    df = stage(attach_phenotypes(long, guide_phenotypes(long, control)), "guide-phenotypes")
    df = in_control_units(stage(query_residuals(df), "residuals"), control)
    if truncate_first:
        df = df.withColumn("score_a", toward_zero(F.col("score_a")))
    key = Window.partitionBy("sample", GUIDE1, GUIDE2)
    last = F.row_number().over(key.orderBy(*[F.col(c).desc() for c in order or [GENE1, GENE2, "fc", "pheno1", "pheno2"]]))
    df = df.withColumn("_own", F.when(last == 1, F.col("score_a") + F.col("score_b")).otherwise(0.0))
    unordered = Window.partitionBy("sample", F.least(GUIDE1, GUIDE2), F.greatest(GUIDE1, GUIDE2))
    share = F.when(F.col(GUIDE1) == F.col(GUIDE2), 2.0).otherwise(4.0)
    return df.withColumn("gi", F.sum("_own").over(unordered) / share).drop("_own")


def gene_pair_gi(constructs: DataFrame, control: str) -> DataFrame:
    """Mean and standard error per gene pair and cell line, without control pairs."""
    keyed = constructs.withColumn("gene_pair", pair_key(F.col(GENE1), F.col(GENE2), "|"))
    scored = mean_and_sem(keyed, ["sample", "gene_pair"], "gi", "sl_score", "standard_error")
    return scored.where(~F.col("gene_pair").contains(control))


def quadratic_gi(screen: DataFrame, layout: Layout, threshold: float = 35.0, truncate_first: bool = True) -> DataFrame:
    """``(sample, gene_pair, sl_score, standard_error)``; phenotypes are written once for the fits to read."""
    long = stage(construct_phenotypes(screen, layout, threshold), "phenotypes")
    return gene_pair_gi(construct_gi(long, layout.control, truncate_first), layout.control)
