"""Truncated z-score of delta log fold change (G1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscreen.operators.effects import delta_effects
from duoscreen.operators.normalize import fold_changes, mean_scaled, row_mean, to_long
from duoscreen.operators.stats import trimmed_z
from duoscreen.screen import CONSTRUCT, Layout
from duoscreen.session import stage


def sample_fold_changes(screen: DataFrame, layout: Layout, pseudo: float = 5.0, keep: Column | None = None) -> DataFrame:
    """Mean-scaled fold change by construct and cell line, long: ``(construct, sample, lfc)``.

    Everything up to the cell-line mean is a row expression; the frame grows only by the number of lines.
    keep: condition on constructs that get a fold change; the others count for the column means only.
    """
    columns = [*layout.late, *layout.early]
    scaled = mean_scaled(screen, columns, pseudo)
    lfc = fold_changes(scaled if keep is None else scaled.where(F.coalesce(keep, F.lit(False))), layout)
    means = lfc.select(*CONSTRUCT, *[row_mean(cols).alias(s) for s, cols in layout.samples.items()])
    return to_long(means, CONSTRUCT, list(layout.samples), "sample", "lfc").where(F.col("lfc").isNotNull())


def zdlfc(
    screen: DataFrame, layout: Layout, positions: str = "left", pseudo: float = 5.0, keep: Column | None = None
) -> DataFrame:
    """``(gene_pair, sample, dlfc, zdlfc)`` for every pair whose two genes have a single effect.

    Fold changes are written once for the single effects and the pair medians to read, and so are the pair effects
    for the percentiles, the moments and the scores.
    """
    long = stage(sample_fold_changes(screen, layout, pseudo, keep), "fold-changes")
    delta = delta_effects(long, layout.control, "lfc", positions).where(F.col("dlfc").isNotNull())
    return trimmed_z(stage(delta.select("gene_pair", "sample", "dlfc"), "pair-effects"), "dlfc")


def unscored(long: DataFrame, layout: Layout, positions: str = "left") -> DataFrame:
    """Pairs without a score because one of their genes has no construct with a control (audit)."""
    delta = delta_effects(long, layout.control, "lfc", positions)
    return delta.where(F.col("dlfc").isNull()).select("gene_pair", "sample", "pair_median")
