"""Regression-residual genetic interaction score with Welch tests and FDR.

Long frames carry ``rep``: a replicate column or a cell line (mean of its replicates). Statistics per ``rep`` are
aggregates joined back from a table of one row per ``rep``; nothing is partitioned by ``rep`` alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscreen.functions.labels import (
    control_guide,
    flag_members,
    pair_key,
    sort_positions,
    target_class,
    targeted_gene,
    targeting_guide,
)
from duoscreen.operators.filters import drop_low_pool, drop_missing, mask_low_pool, mask_zero_points, zero_to_null
from duoscreen.operators.normalize import (
    attach_expression,
    construct_long,
    fold_changes,
    sample_means,
    unexpressed_groups,
)
from duoscreen.operators.ordered import bh_fdr, exact_quantiles
from duoscreen.operators.reshape import widen
from duoscreen.operators.stats import line_fit, moments, welch, with_t_p
from duoscreen.screen import GENE1, GENE2, GUIDE1, GUIDE2, Layout
from duoscreen.session import stage

PAIR = "paralog_pair"
SINGLE_KEY = ["rep", PAIR, "targeting_guide"]


@dataclass(frozen=True)
class Options:
    """Differences between the published uses of the score.

    low_pool: ``mask`` or ``drop`` constructs under ``pool_rpm`` reads per million in the early pool.
    sort_genes: put genes (and guides) in alphabetical order first.
    scale_controls: scale replicates by their control classes.
    expected: ``other_control`` predicts a single construct from the same guide with other controls plus the
        control's own mean; ``observed`` uses its own score, for libraries with one control.
    all_reps: score each replicate as well as the cell-line means.
    log_base: 2, or None for the natural log.
    """

    low_pool: str = "mask"
    pool_rpm: float = 2.0
    sort_genes: bool = False
    scale_controls: bool = True
    expected: str = "other_control"
    all_reps: bool = False
    log_base: float | None = 2.0


def fold_change_table(screen: DataFrame, layout: Layout, essentials: DataFrame, options: Options) -> DataFrame:
    """Wide fold changes with cell-line means, target class and pair key."""
    df = mask_low_pool(screen, layout, options.pool_rpm) if options.low_pool == "mask" else drop_low_pool(
        screen, layout, options.pool_rpm
    )
    df = mask_zero_points(df, layout) if layout.mid else zero_to_null(df, [*layout.late, *layout.early])
    df = sample_means(fold_changes(df, layout, options.log_base), layout)
    if options.sort_genes:
        df = sort_positions(df)
    df = flag_members(flag_members(df, GENE1, essentials, "gene1_essential"), GENE2, essentials, "gene2_essential")
    return df.withColumn(
        "target_class", target_class(layout.control, F.col("gene1_essential"), F.col("gene2_essential"))
    ).withColumn(PAIR, F.concat_ws("_", GENE1, GENE2))


def long_fold_changes(screen: DataFrame, layout: Layout, essentials: DataFrame, options: Options) -> DataFrame:
    """Long fold changes: ``(construct, target_class, paralog_pair, rep, sample, lfc)`` without missing values."""
    wide = fold_change_table(screen, layout, essentials, options)
    reps = list(layout.samples) + (layout.late if options.all_reps else [])
    sample = F.coalesce(
        *[F.when(F.col("rep").isin([s, *cols]), F.lit(s)) for s, cols in layout.samples.items()]
    )
    return construct_long(wide, reps, ["target_class", PAIR]).withColumn("sample", sample)


def crispr_scores(long: DataFrame, expression: DataFrame, layout: Layout, options: Options) -> DataFrame:
    """Fold changes scaled by controls and centred on unexpressed genes: adds ``crispr_score``.

    Scaling is the same linear map for all rows of a replicate, so the medians of the scaled values follow from
    those of the raw ones. All four medians of a replicate come from one pass over the fold changes.
    """
    flagged = attach_expression(long, expression, layout.control)
    group, reference = unexpressed_groups(layout.control)
    flagged = stage(flagged.withColumn("_group", group).withColumn("_reference", reference), "flagged")
    roles = F.array_compact(
        F.array(
            F.when(F.col("target_class").isin("NC", "PC"), F.col("target_class")),
            F.when(F.col("_reference"), F.col("_group")),
        )
    )
    members = flagged.select("rep", "lfc", F.explode(roles).alias("_role"))
    medians = exact_quantiles(members, ["rep", "_role"], "lfc", {"_m": 0.5})
    names = ["NC", "PC", "single", "double"]
    per_rep = medians.groupBy("rep").agg(*[F.max(F.when(F.col("_role") == n, F.col("_m"))).alias(f"_{n}") for n in names])
    if options.scale_controls:
        def scaled(c):
            return F.try_divide(c - F.col("_NC"), F.col("_NC") - F.col("_PC"))
    else:
        def scaled(c):
            return c
    centre = F.when(F.col("_group") == "single", F.col("_single")).when(F.col("_group") == "double", F.col("_double"))
    own = scaled(F.col("lfc"))
    return (
        flagged.join(F.broadcast(per_rep), "rep", "left")
        .withColumn("crispr_score", F.when(F.col("_group") == "control", own).otherwise(own - scaled(centre)))
        .drop("_group", "_reference", *[f"_{n}" for n in names])
    )


def single_constructs(scores: DataFrame, control: str) -> DataFrame:
    """Scored single-target constructs with their targeting and control guide."""
    return (
        scores.where(F.col("target_class").isin("ST", "PC") & F.col("crispr_score").isNotNull())
        .withColumn("targeting_guide", targeting_guide(control))
        .withColumn("control_guide", control_guide(control))
        .withColumn("targeted_gene", targeted_gene(control))
    )


def single_guide_means(scores: DataFrame, control: str) -> DataFrame:
    """Mean score of single constructs by replicate, pair and targeting guide."""
    return (
        single_constructs(scores, control)
        .groupBy(*SINGLE_KEY)
        .agg(F.avg("crispr_score").alias("mean_single_score"))
    )


def control_guide_means(scores: DataFrame) -> DataFrame:
    """Mean score of control-control constructs by replicate and guide, at either position."""
    return (
        scores.where(F.col("target_class") == "NC")
        .select("rep", "crispr_score", F.explode(F.array(GUIDE1, GUIDE2)).alias("control_guide"))
        .groupBy("rep", "control_guide")
        .agg(F.avg("crispr_score").alias("mean_control_score"))
    )


def double_expected(scores: DataFrame, control: str) -> DataFrame:
    """Double constructs with the single means of both guides and their sum.

    A guide that serves several single pairs has several means; the construct then counts once for each.
    """
    doubles = scores.where(F.col("target_class") == "DT").withColumnRenamed("crispr_score", "observed_score")
    singles = single_guide_means(scores, control).where(F.col("targeting_guide").isNotNull())
    for guide, name in ((GUIDE1, "mean_single1"), (GUIDE2, "mean_single2")):
        side = singles.select(
            "rep", F.col("targeting_guide").alias(guide), F.col("mean_single_score").alias(name)
        )
        doubles = doubles.join(side, ["rep", guide], "left")
    return doubles.withColumn("expected_score", F.col("mean_single1") + F.col("mean_single2"))


def _moments(score: Column, name: str) -> list[Column]:
    """Count, mean and sum of squares about the mean: a state that merges without taking differences of large sums."""
    n = F.count(score)
    return [n.alias(f"n_{name}"), F.avg(score).alias(f"mean_{name}"), (F.var_pop(score) * n).alias(f"m2_{name}")]


def other_control_moments(scores: DataFrame, control: str) -> DataFrame:
    """Per guide and control: moments of its own constructs and of those with every other control.

    Matching each construct with the same guide's constructs under other controls would emit all pairs of a
    guide. Everything downstream only needs counts, means and squares about the means over those pairs, and these
    follow from the guide's moments and the control's own part.
    """
    single = single_constructs(scores, control).where(F.col("targeting_guide").isNotNull())
    own = single.groupBy(*SINGLE_KEY, "targeted_gene", "control_guide").agg(*_moments(F.col("crispr_score"), "own"))
    total = single.groupBy(*SINGLE_KEY).agg(*_moments(F.col("crispr_score"), "all"))
    n1, n = F.col("n_own"), F.col("n_all")
    apart = F.col("mean_all") - F.col("mean_own")
    return (
        own.join(total, SINGLE_KEY)
        .withColumn("n_other", n - n1)
        .where(F.col("n_other") > 0)
        .withColumn("mean_other", F.col("mean_all") + apart * n1 / F.col("n_other"))
        .withColumn("m2_other", F.greatest(F.col("m2_all") - F.col("m2_own") - apart * apart * n1 * n / F.col("n_other"), F.lit(0.0)))
        .drop("n_all", "mean_all", "m2_all")
    )


def single_expected(scores: DataFrame, control: str, expected: str = "other_control") -> DataFrame:
    """Observed and expected scores of single constructs, as moments over their ``n_pairs`` matches.

    Columns mean_o, mean_e and the squares and products about them, m2_o, m2_e and c_oe. Each own construct meets
    each other one, so own and other scores do not vary together: c_oe is 0. NULL expectations (control guide without
    a control-control construct) stay in the table for the audit.
    """
    if expected == "observed":
        base = (
            single_constructs(scores, control)
            .groupBy(*SINGLE_KEY, "targeted_gene", "control_guide")
            .agg(*_moments(F.col("crispr_score"), "o"))
            .withColumnRenamed("n_o", "n_pairs")
        )
        return base.withColumns({"mean_e": F.col("mean_o"), "m2_e": F.col("m2_o"), "c_oe": F.col("m2_o")})
    matches = other_control_moments(scores, control).join(control_guide_means(scores), ["rep", "control_guide"], "left")
    n1, n2 = F.col("n_own"), F.col("n_other")
    return matches.withColumns(
        {
            "n_pairs": n1 * n2,
            "mean_o": F.col("mean_own"),
            "mean_e": F.col("mean_other") + F.col("mean_control_score"),
            "m2_o": n2 * F.col("m2_own"),
            "m2_e": n1 * F.col("m2_other"),
            "c_oe": F.lit(0.0),
        }
    )


def usable_singles(singles: DataFrame) -> DataFrame:
    return drop_missing(singles, ["mean_e"])


def target_means(singles: DataFrame) -> DataFrame:
    """Mean expected and observed score per replicate and targeted gene (A10)."""
    return (
        usable_singles(singles)
        .groupBy("rep", "targeted_gene")
        .agg(
            (F.sum(F.col("n_pairs") * F.col("mean_e")) / F.sum("n_pairs")).alias("mean_expected"),
            (F.sum(F.col("n_pairs") * F.col("mean_o")) / F.sum("n_pairs")).alias("mean_observed"),
        )
    )


def single_fit(singles: DataFrame) -> DataFrame:
    """Slope and intercept of observed on expected, per replicate."""
    return line_fit(target_means(singles), "rep", "mean_observed", "mean_expected")


def double_gi(doubles: DataFrame, fit: DataFrame) -> DataFrame:
    """Residual of each double construct; rows without an expectation are left out."""
    return (
        drop_missing(doubles, ["mean_single1", "mean_single2"])
        .join(F.broadcast(fit), "rep", "left")
        .withColumn("gi_score", F.col("observed_score") - (F.col("intercept") + F.col("slope") * F.col("expected_score")))
    )


def single_gi(singles: DataFrame, fit: DataFrame) -> DataFrame:
    """Mean residual of single constructs and its squares about the mean."""
    a, b = F.col("intercept"), F.col("slope")
    m2 = F.col("m2_o") - 2 * b * F.col("c_oe") + b * b * F.col("m2_e")
    return (
        usable_singles(singles)
        .join(F.broadcast(fit), "rep", "left")
        .withColumns({"mean_gi": F.col("mean_o") - (a + b * F.col("mean_e")), "m2_gi": F.greatest(m2, F.lit(0.0))})
    )


def single_pool(singles_gi: DataFrame) -> DataFrame:
    """Moments of all single residuals of a replicate: the reference sample of the Welch test.

    Squares are taken about the mean: those within a guide's matches plus those of the guides' means.
    """
    n = F.col("n_pairs")
    totals = singles_gi.groupBy("rep").agg(
        F.sum("n_pairs").alias("pool_n"), (F.sum(n * F.col("mean_gi")) / F.sum("n_pairs")).alias("pool_mean")
    )
    apart = F.col("mean_gi") - F.col("pool_mean")
    return (
        singles_gi.join(F.broadcast(totals), "rep")
        .groupBy("rep", "pool_n", "pool_mean")
        .agg(F.sum(F.col("m2_gi") + n * apart * apart).alias("_m2"))
        .select("rep", "pool_n", "pool_mean", F.try_divide(F.col("_m2"), F.col("pool_n") - 1).alias("pool_var"))
    )


def pair_tests(doubles_gi: DataFrame, singles_gi: DataFrame) -> DataFrame:
    """Welch t, p-value and FDR of each pair's residuals against the single residuals."""
    pairs = moments(doubles_gi, ["rep", GENE1, GENE2, PAIR], "gi_score", "pair")
    tested = pairs.join(F.broadcast(single_pool(singles_gi)), "rep", "left").withColumns(welch("pool", "pair"))
    return bh_fdr(with_t_p(tested), ["rep"], "p_val", "fdr")


def pair_scores(doubles_gi: DataFrame, singles_gi: DataFrame) -> DataFrame:
    """Mean observed, expected and residual per replicate and pair, doubles with genes and test results."""
    doubles = (
        doubles_gi.groupBy("rep", GENE1, GENE2, PAIR)
        .agg(
            F.avg("observed_score").alias("mean_observed"),
            F.avg("expected_score").alias("mean_expected"),
            F.avg("gi_score").alias("mean_gi"),
        )
        .withColumn("broad_class", F.lit("double"))
        .join(pair_tests(doubles_gi, singles_gi).select("rep", GENE1, GENE2, "p_val", "fdr"), ["rep", GENE1, GENE2], "left")
    )

    def mean(name: str) -> Column:
        return F.sum(F.col("n_pairs") * F.col(name)) / F.sum("n_pairs")

    singles = singles_gi.groupBy("rep", PAIR).agg(
        mean("mean_o").alias("mean_observed"),
        mean("mean_e").alias("mean_expected"),
        mean("mean_gi").alias("mean_gi"),
        F.lit(None).cast("string").alias(GENE1),
        F.lit(None).cast("string").alias(GENE2),
        F.lit("single").alias("broad_class"),
        F.lit(None).cast("double").alias("p_val"),
        F.lit(None).cast("double").alias("fdr"),
    )
    return doubles.unionByName(singles)


def residuals(scores: DataFrame, layout: Layout, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Residuals of double constructs and of single constructs; ``scores`` should be a stored table.

    The moments of single constructs and the double residuals are written once, because several passes read them.
    """
    singles = stage(single_expected(scores, layout.control, options.expected), "single-moments")
    fit = single_fit(singles)
    doubles = stage(double_gi(double_expected(scores, layout.control), fit), "double-residuals")
    return doubles, single_gi(singles, fit)


def regression_gi(
    screen: DataFrame, layout: Layout, essentials: DataFrame, expression: DataFrame, options: Options = Options()
) -> DataFrame:
    """Pair scores by replicate. The score table is written once, because five later passes read it."""
    long = long_fold_changes(screen, layout, essentials, options)
    scores = stage(crispr_scores(long, expression, layout, options), "crispr-scores")
    return pair_scores(*residuals(scores, layout, options))


def wide_pairs(pairs: DataFrame, layout: Layout) -> DataFrame:
    """One row per pair: score, FDR and p-value of every cell line, alphabetical key."""
    doubles = pairs.where((F.col("broad_class") == "double") & F.col("rep").isin(list(layout.samples)))
    values = {"gi": "mean_gi", "fdr": "fdr", "p_val": "p_val"}
    wide = widen(doubles, [GENE1, GENE2], "rep", list(layout.samples), values)
    return wide.withColumn(PAIR, pair_key(F.col(GENE1), F.col(GENE2))).drop(GENE1, GENE2)
