"""Pair fold changes against sums of single fold changes, by a moderated t-test or a rank-sum test.

Taken from the published description of the method; its package is not part of what this engine was checked
against. A residual is the fold change of a double construct minus the mean single fold change of its first gene at
position 1 and of its second gene at position 2. The mean over all sums of single constructs equals the sum of
the two means, so the sums are never enumerated.

Definitions of this engine where the description leaves room: the rank-sum test compares the fold changes of a pair's
double constructs with one sum of single fold changes for each of them, that of its own two guides (means over the
control partners of each guide), as all sums of single constructs would be all pairs of a group. With ``loess`` the trend
of the residuals over the expected fold change, by local regression within a cell line, is taken out first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscreen.functions.labels import pair_key, split_by_arity
from duoscreen.operators.filters import drop_listed_genes, within_reads
from duoscreen.operators.normalize import depth_normalised_fold_change, row_mean, to_long
from duoscreen.operators.ordered import bh_fdr
from duoscreen.operators.smooth import local_trend
from duoscreen.operators.stats import moderated_t, rank_sum_test
from duoscreen.screen import CONSTRUCT, GENE1, GENE2, GUIDE1, GUIDE2, Layout
from duoscreen.session import stage


def screen_fold_changes(
    screen: DataFrame, layout: Layout, min_reads: float = 0.0, max_reads: float = float("inf")
) -> DataFrame:
    """Depth-normalised fold change by construct and cell line, within the early read window."""
    df = depth_normalised_fold_change(screen, layout)
    for c in layout.early:
        df = within_reads(df, c, min_reads, max_reads)
    means = df.select(*CONSTRUCT, *[row_mean(cols).alias(s) for s, cols in layout.samples.items()])
    return to_long(means, CONSTRUCT, list(layout.samples), "sample", "lfc").where(F.col("lfc").isNotNull())


def pair_residuals(
    long: DataFrame, control: str, filter_genes: Sequence[str] = (), ignore_orientation: bool = True
) -> DataFrame:
    """Observed, expected and residual fold change of every double construct (G6, ``return_residuals``)."""
    residuals = all_residuals(long, control, filter_genes, ignore_orientation)
    return residuals.where(F.col("residual").isNotNull())


def unscored_constructs(
    long: DataFrame, control: str, filter_genes: Sequence[str] = (), ignore_orientation: bool = True
) -> DataFrame:
    """Double constructs without a residual because a gene has no single construct (audit)."""
    residuals = all_residuals(long, control, filter_genes, ignore_orientation)
    return residuals.where(F.col("residual").isNull()).select(*CONSTRUCT, "sample", "gene_pair", "lfc")


def all_residuals(
    long: DataFrame,
    control: str,
    filter_genes: Sequence[str] = (),
    ignore_orientation: bool = True,
    by_guide: bool = False,
) -> DataFrame:
    """All double constructs; residual and expected are NULL where a single effect is missing.

    Single effects are means by gene, or with ``by_guide`` by gene and guide. With ``ignore_orientation`` a gene (or
    guide) that has no single construct at its own position takes its mean at the other.
    """
    parts = split_by_arity(long, control)
    single = parts["single"]
    key1, key2 = ([GENE1, GUIDE1], [GENE2, GUIDE2]) if by_guide else ([GENE1], [GENE2])
    first = single.where(F.col(GENE2) == control).groupBy("sample", *key1).agg(F.avg("lfc").alias("single1"))
    second = single.where(F.col(GENE1) == control).groupBy("sample", *key2).agg(F.avg("lfc").alias("single2"))
    combn = drop_listed_genes(parts["combn"], filter_genes) if filter_genes else parts["combn"]
    key = pair_key(F.col(GENE1), F.col(GENE2)) if ignore_orientation else F.concat_ws("_", GENE1, GENE2)
    joined = combn.join(first, ["sample", *key1], "left").join(second, ["sample", *key2], "left")
    if ignore_orientation:
        for keys, own, other in ((key1, "single1", second), (key2, "single2", first)):
            names = dict(zip(key1, keys)) | dict(zip(key2, keys)) | {"single1": "_other", "single2": "_other"}
            joined = joined.join(other.withColumnsRenamed(names), ["sample", *keys], "left")
            joined = joined.withColumn(own, F.coalesce(own, "_other")).drop("_other")
    return (
        joined.withColumn("gene_pair", key)
        .withColumn("expected", F.col("single1") + F.col("single2"))
        .withColumn("residual", F.col("lfc") - F.col("expected"))
        .drop("single1", "single2")
    )


def score_pairs(residuals: DataFrame) -> DataFrame:
    """Mean residual, moderated t, p-value and FDR per pair and cell line."""
    moments = residuals.groupBy("sample", "gene_pair").agg(
        F.count("residual").alias("n"),
        F.avg("lfc").alias("mean_observed"),
        F.avg("expected").alias("mean_expected"),
        F.avg("residual").alias("effect"),
        F.var_samp("residual").alias("variance"),
    )
    tested = moderated_t(stage(moments, "pair-moments"), "sample", "effect", "variance", "n")
    return bh_fdr(tested, ["sample"], "p_val", "fdr")


def without_trend(residuals: DataFrame, knots: int = 41, reach: int = 12) -> DataFrame:
    """Residuals less their trend over the expected fold change, which stays as ``trend`` (G6, ``loess``)."""
    fitted = local_trend(residuals, "sample", "expected", "residual", "trend", knots, reach)
    return fitted.withColumn("residual", F.col("residual") - F.col("trend"))


def rank_pairs(sums: DataFrame) -> DataFrame:
    """Rank-sum test of a pair's fold changes against its sums of single fold changes, with FDR (G6, ``rank-sum``).

    sums: double constructs with ``lfc`` and ``expected`` by guide; ``n`` counts those that have both.
    """
    both = sums.where(F.col("lfc").isNotNull() & F.col("expected").isNotNull())
    moments = both.groupBy("sample", "gene_pair").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("lfc").alias("mean_observed"),
        F.avg("expected").alias("mean_expected"),
        F.avg(F.col("lfc") - F.col("expected")).alias("effect"),
    )
    tested = rank_sum_test(both, ["sample", "gene_pair"], "lfc", "expected").drop("n1", "n2")
    return bh_fdr(moments.join(tested, ["sample", "gene_pair"]), ["sample"], "p_val", "fdr")


def call_hits(
    scores: DataFrame,
    fdr: float = 0.2,
    effect: float = 0.5,
    negative: str = "Sensitizer",
    positive: str = "Suppressor",
) -> DataFrame:
    """Label pairs that pass both cut-offs by the direction of the effect."""
    passes = (F.col("fdr") < fdr) & (F.abs("effect") > effect)
    return scores.withColumn(
        "call", F.when(passes & (F.col("effect") < 0), negative).when(passes, positive).otherwise("None")
    )


def moderated_gi(
    screen: DataFrame,
    layout: Layout,
    filter_genes: Sequence[str] = (),
    ignore_orientation: bool = True,
    min_reads: float = 0.0,
    max_reads: float = float("inf"),
    test: str = "moderated-t",
    loess: bool = False,
) -> DataFrame:
    """Scores and calls of all pairs of constructs whose early reads lie in the window.

    ``test`` is moderated-t or rank-sum; ``loess`` takes the trend out of the residuals, so it goes with moderated-t.
    """
    if test not in ("moderated-t", "rank-sum"):
        raise ValueError(f"unknown test {test}")
    if loess and test == "rank-sum":
        raise ValueError("loess changes residuals, which the rank-sum test does not use")
    long = stage(screen_fold_changes(screen, layout, min_reads, max_reads), "fold-changes")
    if test == "rank-sum":
        return call_hits(rank_pairs(stage(all_residuals(long, layout.control, filter_genes, ignore_orientation, True), "guide-sums")))
    residuals = pair_residuals(long, layout.control, filter_genes, ignore_orientation)
    return call_hits(score_pairs(without_trend(stage(residuals, "residuals")) if loess else residuals))
