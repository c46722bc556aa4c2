"""Single-gene effects and expected pair effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscreen.functions.labels import pair_key
from duoscreen.operators.ordered import grouped_median
from duoscreen.screen import GENE1, GENE2


def position_effects(long: DataFrame, control: str, value: str = "lfc") -> tuple[DataFrame, DataFrame]:
    """Mean effect of each gene at position 1 and at position 2, over its constructs with a control (A1).

    The control itself is kept as a gene of its own. Plain means, so a gene in a third of all constructs costs
    one partial row per task.
    """

    def side(gene: str, partner: str, name: str) -> DataFrame:
        return (
            long.where(F.col(partner) == control)
            .groupBy("sample", F.col(gene).alias("gene"))
            .agg(F.avg(value).alias(name))
        )

    return side(GENE1, GENE2, "effect_a"), side(GENE2, GENE1, "effect_b")


def gene_effects(long: DataFrame, control: str, value: str = "lfc", positions: str = "left") -> DataFrame:
    """Single-mutant effect of a gene: the mean of its two position means.

    positions: ``left`` needs the gene at position 1, ``union`` takes either, ``first`` uses position 1 only.
    """
    a, b = position_effects(long, control, value)
    if positions == "first":
        return a.withColumn("effect_b", F.lit(None).cast("double")).withColumn("smf", F.col("effect_a"))
    how = {"left": "left", "union": "full"}[positions]
    both = a.join(b, ["sample", "gene"], how)
    present = F.col("effect_a").isNotNull().cast("int") + F.col("effect_b").isNotNull().cast("int")
    total = F.coalesce("effect_a", F.lit(0.0)) + F.coalesce("effect_b", F.lit(0.0))
    return both.withColumn("smf", F.try_divide(total, present))


def pair_medians(long: DataFrame, control: str, value: str = "lfc") -> DataFrame:
    """Median effect of each gene pair over both orientations."""
    pairs = (
        long.where((F.col(GENE1) != control) & (F.col(GENE2) != control))
        .withColumn("gene_a", F.least(GENE1, GENE2))
        .withColumn("gene_b", F.greatest(GENE1, GENE2))
    )
    return grouped_median(pairs, ["gene_a", "gene_b", "sample"], value, "pair_median")


def delta_effects(long: DataFrame, control: str, value: str = "lfc", positions: str = "left") -> DataFrame:
    """Pair median minus the sum of both single-gene effects.

    NULL when a gene has no single effect; such pairs stay in the table so that they can be reported.
    """
    smf = gene_effects(long, control, value, positions).select("sample", "gene", "smf")
    one = smf.select("sample", F.col("gene").alias("gene_a"), F.col("smf").alias("smf_a"))
    two = smf.select("sample", F.col("gene").alias("gene_b"), F.col("smf").alias("smf_b"))
    return (
        pair_medians(long, control, value)
        .join(one, ["sample", "gene_a"], "left")
        .join(two, ["sample", "gene_b"], "left")
        .withColumn("dlfc", F.col("pair_median") - (F.col("smf_a") + F.col("smf_b")))
        .withColumn("gene_pair", pair_key(F.col("gene_a"), F.col("gene_b")))
    )
