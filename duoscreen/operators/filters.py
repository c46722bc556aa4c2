"""Filters and masks of screen tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscreen.functions.rows import row_mean
from duoscreen.operators.ordered import grouped_median
from duoscreen.screen import GENE1, GENE2, GUIDE1, GUIDE2, Layout


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """Put the only row of ``row`` on every row of ``df`` as a struct column.

    A scalar subquery in a projection of its own: no join, no window over everything, and one subquery however
    often its fields are used.
    """
    return df.withColumn(name, row.select(F.struct(*row.columns).alias(name)).scalar())


def with_totals(df: DataFrame, columns: Sequence[str], fn=F.sum, name: str = "_totals") -> DataFrame:
    """An aggregate of each column over the whole table, as a struct column."""
    return with_row(df, df.agg(*[fn(F.col(c)).alias(c) for c in columns]), name)


def rpm(column: str, totals: str = "_totals") -> Column:
    """Reads per million of a column."""
    return F.try_divide(F.col(column) * 1e6, F.col(f"{totals}.{column}"))


def mask_low_pool(df: DataFrame, layout: Layout, threshold: float = 2.0) -> DataFrame:
    """Null out late columns where their early pool has fewer reads per million (F1).

    The pool of a late column is that of its cell line, of its own replicate, or the mean of the cell line's early
    replicates, as the layout says.
    """
    masked = {}
    for c in layout.late:
        low = row_mean([rpm(e) for e in layout.early_for(c)]) < threshold
        for own in [c, layout.mid[c]] if c in layout.mid else [c]:
            masked[own] = F.when(~low, F.col(own))
    for c in layout.early:
        masked[c] = F.when(~(rpm(c) < threshold), F.col(c))
    return with_totals(df, layout.early).withColumns(masked).drop("_totals")


def drop_low_pool(df: DataFrame, layout: Layout, threshold: float = 2.0) -> DataFrame:
    """Drop constructs whose early pool has fewer reads per million in any early column (F2)."""
    keep = F.lit(True)
    for c in layout.early:
        keep = keep & (rpm(c) >= threshold)
    return with_totals(df, layout.early).where(keep).drop("_totals")


def mask_zero_points(df: DataFrame, layout: Layout) -> DataFrame:
    """Null a late count when it or its mid time point is zero or missing."""
    masked = {}
    for c in layout.late:
        usable = F.col(c) != 0
        if c in layout.mid:
            usable = usable & (F.col(layout.mid[c]) != 0)
        masked[c] = F.when(usable, F.col(c))
    return df.withColumns(masked)


def zero_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero counts become missing."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in columns})


def exclude(df: DataFrame, column: str, values: Sequence[str] = (), patterns: Sequence[str] = ()) -> DataFrame:
    """Drop constructs of the given types."""
    hit = F.col(column).isin(list(values)) if values else F.lit(False)
    for p in patterns:
        hit = hit | F.col(column).rlike(p)
    return df.where(~F.coalesce(hit, F.lit(False)))


def guide_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median count of each guide at each position and replicate: ``(position, guide, rep, median_count)``.

    Control guides sit in a large part of all constructs; the exact median never holds a group in one task.
    """
    count_of = F.explode(F.array(*[F.struct(F.lit(c).alias("rep"), F.col(c).alias("count")) for c in columns]))
    placed = F.explode(
        F.array(
            F.struct(F.lit(1).alias("position"), F.col(GUIDE1).alias("guide")),
            F.struct(F.lit(2).alias("position"), F.col(GUIDE2).alias("guide")),
        )
    )
    long = (
        df.select(placed.alias("_p"), *columns)
        .select("_p.position", "_p.guide", count_of.alias("_c"))
        .select("position", "guide", "_c.rep", "_c.count")
    )
    return grouped_median(long, ["position", "guide", "rep"], "count", "median_count")


def low_count_guides(df: DataFrame, columns: Sequence[str], threshold: float = 35.0) -> DataFrame:
    """Guides whose median late count is low at either position: ``(guide, reps)``, replicates as an array."""
    return (
        guide_medians(df, columns)
        .where(F.col("median_count") < threshold)
        .groupBy("guide")
        .agg(F.sort_array(F.collect_set("rep")).alias("reps"))
    )


def mask_low_count_guides(df: DataFrame, columns: Sequence[str], threshold: float = 35.0) -> DataFrame:
    """Null the replicates in which one of a construct's guides is low.

    Counts are never negative, so a threshold of zero costs nothing.
    """
    if threshold <= 0:
        return df
    low = low_count_guides(df, columns, threshold)
    for guide, name in ((GUIDE1, "_low1"), (GUIDE2, "_low2")):
        df = df.join(low.select(F.col("guide").alias(guide), F.col("reps").alias(name)), guide, "left")

    def listed(name: str, c: str) -> Column:
        return F.coalesce(F.array_contains(name, c), F.lit(False))

    return df.withColumns({c: F.when(~listed("_low1", c) & ~listed("_low2", c), F.col(c)) for c in columns}).drop(
        "_low1", "_low2"
    )


def within_reads(df: DataFrame, column: str, low: float = 0.0, high: float = float("inf")) -> DataFrame:
    """Keep constructs whose early count lies in the window."""
    return df.where((F.col(column) >= low) & (F.col(column) <= high))


def drop_empty_replicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Remove replicate columns that hold no value at all (F8).

    The output schema depends on the data, so this runs one aggregate and reads its single row.
    """
    filled = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if filled[c] == 0])


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows where one of the columns is missing."""
    return df.na.drop("any", subset=list(columns))


def removed_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows that ``drop_missing`` removes, for audit."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.where(missing)


def drop_control_pairs(df: DataFrame, column: str, token: str) -> DataFrame:
    """Drop result pairs whose key contains the control token."""
    return df.where(~F.col(column).contains(token))


def _substrings(df: DataFrame, column: str, lengths: Sequence[int] | None = None) -> DataFrame:
    """``df`` with ``_part``: every substring of a column, or those of the given lengths."""
    size = F.length(column)
    wanted = F.sequence(F.lit(1), size) if lengths is None else F.array(*[F.lit(n) for n in lengths])
    sized = df.where(size > 0).withColumn("_n", F.explode(wanted)).where(F.col("_n") <= F.length(column))
    starts = F.explode(F.sequence(F.lit(1), F.length(column) - F.col("_n") + 1))
    return sized.withColumn("_at", starts).withColumn("_part", F.substring(F.col(column), F.col("_at"), F.col("_n"))).drop("_n", "_at")


def drop_control_genes(
    df: DataFrame, genes: Sequence[str], controls: Sequence[str], substring: bool = True
) -> DataFrame:
    """Drop rows where a gene is part of a control name, or (``substring``) a control name is part of it.

    Only the distinct genes are tried, by equi joins: against all substrings of the names, and with those of their own
    substrings that are as long as some name against the names. The rows then lose the genes found, so neither
    plan nor cost per row grows with the list. Rows without one of the genes go too; an empty gene is part of any name.
    """
    names = sorted(set(controls))
    if not names:
        return df
    if substring and "" in names:
        return df.where(F.lit(False))
    listed = df.sparkSession.createDataFrame([(n,) for n in names], "name string")
    tried = df.select(F.explode(F.array(*genes)).alias("_gene")).where(F.col("_gene").isNotNull()).distinct()
    parts = _substrings(listed, "name").select(F.col("_part").alias("_gene")).distinct()
    found = tried.join(parts, "_gene", "left_semi")
    if substring:
        held = _substrings(tried, "_gene", sorted({len(n) for n in names}))
        held = held.join(listed.withColumnRenamed("name", "_part"), "_part", "left_semi").select("_gene")
        found = found.unionByName(held).distinct()
    kept = df
    for gene in genes:
        kept = kept.where(F.col(gene) != "").join(found.withColumnRenamed("_gene", gene), gene, "left_anti")
    return kept.select(*df.columns)


def keep_scored_genes(
    counts: DataFrame, scores: DataFrame, line: str, genes: tuple[str, str], controls: Sequence[str]
) -> DataFrame:
    """Keep constructs whose genes occur in the scores of the same cell line, or are controls."""
    scored = (
        scores.select(line, F.explode(F.array(*genes)).alias("_gene"))
        .distinct()
        .withColumn("_scored", F.lit(True))
    )
    control = F.lit(False)
    both = F.lit(True)
    for i, gene in enumerate(genes):
        mark = scored.select(line, F.col("_gene").alias(gene), F.col("_scored").alias(f"_s{i}"))
        counts = counts.join(mark, [line, gene], "left")
        both = both & (F.coalesce(F.col(f"_s{i}"), F.lit(False)) | F.col(gene).isin(list(controls)))
    if "target_type" in counts.columns:
        control = F.col("target_type") == "Control"
    return counts.where(both | control).drop("_s0", "_s1")


def hits(df: DataFrame, score: str = "zdlfc", below: float = -3.0) -> DataFrame:
    """Rows with a score under the cut-off."""
    return df.where(F.col(score) < below)


def pair_hits(df: DataFrame, key: str, score: str = "zdlfc", below: float = -3.0) -> DataFrame:
    """Pairs with a hit in any sample, and in how many."""
    return df.groupBy(key).agg(F.count_if(F.col(score) < below).alias("n_hits")).where(F.col("n_hits") > 0)


def drop_same_gene(df: DataFrame, gene1: str = GENE1, gene2: str = GENE2) -> DataFrame:
    """Drop pairs of a gene with itself."""
    return df.where(F.col(gene1) != F.col(gene2))


def drop_listed_genes(df: DataFrame, genes: Sequence[str], columns: Sequence[str] = (GENE1, GENE2)) -> DataFrame:
    """Drop constructs that involve one of the listed genes."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).isin(list(genes))
    return df.where(~hit)
