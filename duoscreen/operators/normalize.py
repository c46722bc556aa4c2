"""Normalisation and fold change of wide screen tables: row expressions plus scalar subqueries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscreen.functions.labels import gene_ordered_guides
from duoscreen.functions.rows import row_mean, row_mean_complete  # noqa: F401
from duoscreen.operators.filters import with_row, with_totals
from duoscreen.operators.ordered import exact_quantiles
from duoscreen.screen import CONSTRUCT, GENE1, GENE2, Layout


def library_sizes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reads per sample, one row per sample."""
    return to_long(df.agg(*[F.sum(c).alias(c) for c in columns]), [], columns, "sample", "reads")


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(columns), name, value)


def mean_scaled(df: DataFrame, columns: Sequence[str], pseudo: float = 5.0, target: float = 500.0) -> DataFrame:
    """Scale each column to a mean of ``target`` after adding a pseudo count."""
    scaled = {c: (F.col(c) + pseudo) / F.col(f"_means.{c}") * target for c in columns}
    return with_totals(df, columns, lambda c: F.avg(c + pseudo), "_means").withColumns(scaled).drop("_means")


def log_ratio(late: Column, early: Column, base: float | None = 2.0) -> Column:
    """Log fold change; NULL where a count is missing or zero (N3). ``base=None`` is the natural log."""
    ratio = F.nullif(F.try_divide(late, early), F.lit(0.0))
    return F.log(ratio) if base is None else F.log2(ratio) if base == 2.0 else F.log(ratio) / F.log(F.lit(base))


def fold_changes(df: DataFrame, layout: Layout, base: float | None = 2.0) -> DataFrame:
    """Replace every late count by its log fold change against its early column or their mean."""
    return df.withColumns({c: log_ratio(F.col(c), row_mean(layout.early_for(c)), base) for c in layout.late})


def sample_means(df: DataFrame, layout: Layout) -> DataFrame:
    """One column per cell line: the mean of its replicates that are present."""
    return df.withColumns({s: row_mean(cols) for s, cols in layout.samples.items()})


def fitness_fold_change(
    df: DataFrame, layout: Layout, control: Column, pseudo: float = 10.0, doublings: float = 6.3
) -> DataFrame:
    """Depth-adjusted fold change per replicate, centred on control constructs, per doubling.

    A missing late or early count leaves the replicate missing and out of the depth sums. Control medians of all
    replicates come from one exact pass over the control constructs.
    """
    late, early = layout.late, {c: row_mean(layout.early_for(c)) for c in layout.late}
    present = {c: F.col(c).isNotNull() & early[c].isNotNull() for c in late}
    sums = df.agg(
        *[F.sum(F.when(present[c], early[c] + pseudo)).alias(f"s_{c}") for c in late],
        *[F.sum(F.when(present[c], F.col(c) + pseudo)).alias(f"e_{c}") for c in late],
    )
    raw = (
        with_row(df, sums, "_sums")
        .withColumns(
            {
                c: F.log2(
                    (F.col(c) + pseudo)
                    / (early[c] + pseudo)
                    / F.try_divide(F.col(f"_sums.s_{c}"), F.col(f"_sums.e_{c}"))
                )
                for c in late
            }
        )
        .drop("_sums")
    )
    controls = to_long(raw.where(control).select(*late), [], late, "rep", "value")
    centre = replicate_row(exact_quantiles(controls, ["rep"], "value", {"median": 0.5}), late, "median")
    centred = {c: (F.col(c) - F.coalesce(F.col(f"_centre.{c}"), F.lit(0.0))) / doublings for c in late}
    return with_row(raw, centre, "_centre").withColumns(centred).drop("_centre")


def replicate_row(long: DataFrame, reps: Sequence[str], value: str) -> DataFrame:
    """A table of one value per replicate as one row with a column per replicate."""
    return long.agg(*[F.max(F.when(F.col("rep") == c, F.col(value))).alias(c) for c in reps])


def orientation_average(df: DataFrame, columns: Sequence[str], suffix: str = "_abba") -> DataFrame:
    """Mean over both orientations of the same guide pair, put back on every construct."""
    keyed = df.withColumn("guide_pair", gene_ordered_guides())
    means = keyed.groupBy("guide_pair").agg(*[F.avg(c).alias(f"{c}{suffix}") for c in columns])
    return keyed.join(means, "guide_pair", "left")


def average_sides(df: DataFrame, early: Sequence[str], late: Sequence[str], names=("t0", "tend")) -> DataFrame:
    """Unequal numbers of early and late replicates: average each side to one column."""
    return df.withColumns({names[0]: row_mean(early), names[1]: row_mean(late)})


def log_counts(column: str, scale: float = 1e6, pseudo: float = 1.0) -> Column:
    """Depth-scaled log2 counts."""
    return F.log2(F.col(column) / F.col(f"_totals.{column}") * scale + pseudo)


def depth_normalised_fold_change(df: DataFrame, layout: Layout, scale: float = 1e6, pseudo: float = 1.0) -> DataFrame:
    """Depth-scaled log2 counts of each late replicate minus those of its early column or their mean."""
    changes = {
        c: log_counts(c, scale, pseudo) - row_mean([log_counts(e, scale, pseudo) for e in layout.early_for(c)])
        for c in layout.late
    }
    return with_totals(df, [*layout.late, *layout.early]).withColumns(changes).drop("_totals")


def median_normalised_fold_change(df: DataFrame, layout: Layout, constant: float = 32.0) -> DataFrame:
    """log2(count + constant) centred on the median of its column, late minus early."""
    columns = [*layout.late, *layout.early]
    logged = df.withColumns({c: F.log2(F.col(c) + constant) for c in columns})
    medians = exact_quantiles(to_long(logged.select(*columns), [], columns, "rep", "v"), ["rep"], "v", {"m": 0.5})

    def centred(c: str) -> Column:
        return F.col(c) - F.col(f"_centre.{c}")

    changes = {c: centred(c) - row_mean([centred(e) for e in layout.early_for(c)]) for c in layout.late}
    return with_row(logged, replicate_row(medians, columns, "m"), "_centre").withColumns(changes).drop("_centre")


def control_scaled(long: DataFrame, value: str = "lfc", by: str = "rep", cls: str = "target_class") -> DataFrame:
    """Set the median of NC constructs to 0 and of PC constructs to -1 in every replicate."""
    medians = class_medians(long, value, by, cls, ["NC", "PC"])
    nc, pc = F.col("_NC"), F.col("_PC")
    return (
        long.join(F.broadcast(medians), by, "left")
        .withColumn("lfc_centred", F.col(value) - nc)
        .withColumn("lfc_scaled", F.try_divide(F.col(value) - nc, nc - pc))
        .drop("_NC", "_PC")
    )


def class_medians(long: DataFrame, value: str, by: str, cls: str, classes: Sequence[str]) -> DataFrame:
    """One row per replicate with a column ``_<class>`` for the median of each class."""
    medians = exact_quantiles(long.where(F.col(cls).isin(list(classes))), [by, cls], value, {"m": 0.5})
    return medians.groupBy(by).agg(*[F.max(F.when(F.col(cls) == c, F.col("m"))).alias(f"_{c}") for c in classes])


def attach_expression(
    long: DataFrame, expression: DataFrame, control: str, sample: str = "sample"
) -> DataFrame:
    """Expression flags of both genes, by gene and cell line; unknown counts as expressed.

    ``expression`` is ``(gene, sample, is_expressed)``. Its size is the planner's to judge, so no broadcast hint.
    """
    for gene, flag in ((GENE1, "gene1_expressed"), (GENE2, "gene2_expressed")):
        side = expression.select(
            F.col("gene").alias(gene), F.col("sample").alias(sample), F.col("is_expressed").alias(flag)
        )
        long = long.join(side, [gene, sample], "left")
        long = long.withColumn(flag, F.when(F.col(flag).isNull() & (F.col(gene) != control), True).otherwise(F.col(flag)))
    return long


def unexpressed_groups(control: str, cls: str = "target_class") -> tuple[Column, Column]:
    """Centring group of a construct, and whether it belongs to the group's unexpressed reference set."""
    off1, off2 = F.col("gene1_expressed") == F.lit(False), F.col("gene2_expressed") == F.lit(False)
    group = F.when(F.col(cls).isin("PC", "ST"), "single").when(F.col(cls) == "DT", "double").otherwise("control")
    single = ((F.col(GENE2) == control) & off1) | ((F.col(GENE1) == control) & off2)
    reference = F.when(group == "single", single).when(group == "double", off1 & off2).otherwise(F.lit(False))
    return group, F.coalesce(reference, F.lit(False))


def unexpressed_recentred(long: DataFrame, control: str, value: str = "lfc_scaled", by: str = "rep") -> DataFrame:
    """Centre single and double constructs on their unexpressed genes; control constructs stay.

    A class without any unexpressed construct gets a missing score.
    """
    group, reference = unexpressed_groups(control)
    marked = long.withColumn("_group", group).withColumn("_reference", reference)
    medians = exact_quantiles(marked.where("_reference"), [by, "_group"], value, {"_centre": 0.5}).drop("n")
    return (
        marked.join(F.broadcast(medians), [by, "_group"], "left")
        .withColumn(
            "crispr_score",
            F.when(F.col("_group") == "control", F.col(value)).otherwise(F.col(value) - F.col("_centre")),
        )
        .drop("_group", "_reference", "_centre")
    )


def construct_long(df: DataFrame, columns: Sequence[str], extra: Sequence[str] = (), value: str = "lfc") -> DataFrame:
    """Constructs by replicate, without missing values."""
    return to_long(df, [*CONSTRUCT, *extra], columns, "rep", value).where(F.col(value).isNotNull())
