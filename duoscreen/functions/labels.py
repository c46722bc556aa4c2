"""Column expressions that parse, relabel and classify constructs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscreen.screen import CONSTRUCT, GENE1, GENE2, GUIDE1, GUIDE2


def split_into(df: DataFrame, column: str, pattern: str, names: Sequence[str], merge: bool = True) -> DataFrame:
    """Split an id into parts by a regex. With ``merge`` the last part keeps any further separators."""
    parts = F.split(F.col(column), pattern, len(names) if merge else -1)
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(names)})


def relabel(
    gene: Column,
    token: str,
    names: Sequence[str] = (),
    patterns: Sequence[str] = (),
    contains: Sequence[str] = (),
    prefixes: Sequence[str] = (),
    when: Column | None = None,
) -> Column:
    """Replace control genes by one token: by name, regex, substring, prefix or any other condition."""
    tests = [gene.isin(list(names))] if names else []
    tests += [gene.rlike(p) for p in patterns]
    tests += [gene.contains(c) for c in contains]
    tests += [gene.startswith(p) for p in prefixes]
    tests += [when] if when is not None else []
    hit = F.lit(False)
    for test in tests:
        hit = hit | F.coalesce(test, F.lit(False))
    return F.when(hit, F.lit(token)).otherwise(gene)


def flag_members(df: DataFrame, column: str, members: DataFrame, name: str) -> DataFrame:
    """Boolean column: is ``column`` in the first column of ``members``.

    A left join on distinct members. No broadcast is forced: the planner broadcasts the list if it is small.
    """
    listed = members.select(F.col(members.columns[0]).alias(column)).distinct().withColumn(name, F.lit(True))
    return df.join(listed, column, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def relabel_members(df: DataFrame, column: str, members: DataFrame, token: str) -> DataFrame:
    """Replace genes of a list table by one token (P2 with a long list)."""
    flagged = flag_members(df, column, members, "_listed")
    return flagged.withColumn(column, F.when(F.col("_listed"), F.lit(token)).otherwise(F.col(column))).drop("_listed")


def pair_key(a: Column, b: Column, sep: str = "_") -> Column:
    """Alphabetical pair key."""
    return F.concat_ws(sep, F.least(a, b), F.greatest(a, b))


def sort_positions(df: DataFrame) -> DataFrame:
    """Put the alphabetically first gene at position 1 and move the guides with it."""
    here = F.struct(F.col(GENE1).alias("g"), F.col(GUIDE1).alias("s"))
    there = F.struct(F.col(GENE2).alias("g"), F.col(GUIDE2).alias("s"))
    keep = F.col(GENE1) < F.col(GENE2)
    rest = [c for c in df.columns if c not in CONSTRUCT]
    return df.select(
        F.when(keep, here).otherwise(there).alias("_a"), F.when(keep, there).otherwise(here).alias("_b"), *rest
    ).select(
        F.col("_a.g").alias(GENE1),
        F.col("_b.g").alias(GENE2),
        F.col("_a.s").alias(GUIDE1),
        F.col("_b.s").alias(GUIDE2),
        *rest,
    )


def gene_ordered_guides(sep: str = "|") -> Column:
    """Guide pair key whose guides follow the order of their genes; same-gene pairs keep their order."""
    swap = F.col(GENE1) > F.col(GENE2)
    return F.when(swap, F.concat_ws(sep, GUIDE2, GUIDE1)).otherwise(F.concat_ws(sep, GUIDE1, GUIDE2))


def target_class(control: str, essential1: Column, essential2: Column) -> Column:
    """NC control with control, PC control with essential gene, DT two genes, ST anything else (P5)."""
    c1, c2 = F.col(GENE1) == control, F.col(GENE2) == control
    return (
        F.when(c1 & c2, "NC")
        .when((c1 != c2) & (essential1 | essential2), "PC")
        .when(~c1 & ~c2 & (F.col(GENE1) != F.col(GENE2)), "DT")
        .otherwise("ST")
    )


def target_class_by_origin(control: str, origin: Column, essential_origin: str) -> Column:
    """Variant of the class for libraries with the control always at position 2 and an origin column (P5)."""
    c1, c2 = F.col(GENE1) == control, F.col(GENE2) == control
    return (
        F.when((origin == essential_origin) & c2, "PC")
        .when(c1 & c2, "NC")
        .when(c2 & ~c1, "ST")
        .otherwise("DT")
    )


def target_arity(control: str) -> Column:
    """Dual, Single (one control, or the same gene twice) or Control."""
    c1, c2 = F.col(GENE1) == control, F.col(GENE2) == control
    return (
        F.when(c1 & c2, "Control").when(c1 | c2 | (F.col(GENE1) == F.col(GENE2)), "Single").otherwise("Dual")
    )


def same_gene_is_dual(arity: Column) -> Column:
    """Count a gene paired with itself as Dual."""
    return F.when((arity == "Single") & (F.col(GENE1) == F.col(GENE2)), "Dual").otherwise(arity)


def orientation(ascending_is_ab: bool = True) -> Column:
    """``A_B`` or ``B_A``. Two opposite conventions are in use (P11):

    ascending_is_ab=True labels gene1 <= gene2 as A_B, False labels gene1 > gene2 as A_B.
    """
    test = F.col(GENE1) <= F.col(GENE2) if ascending_is_ab else F.col(GENE1) > F.col(GENE2)
    return F.when(test, "A_B").otherwise("B_A")


def targeting_guide(control: str) -> Column:
    """Guide of the targeted gene of a single-target construct (P21); NULL without a control partner."""
    return F.when(F.col(GENE2) == control, F.col(GUIDE1)).when(F.col(GENE1) == control, F.col(GUIDE2))


def control_guide(control: str) -> Column:
    """Guide of the control of a single-target construct."""
    return F.when(F.col(GENE2) == control, F.col(GUIDE2)).when(F.col(GENE1) == control, F.col(GUIDE1))


def targeted_gene(control: str) -> Column:
    return F.when(F.col(GENE1) == control, F.col(GENE2)).otherwise(F.col(GENE1))


def fill_partner(partner: Column, own: Column, empty: str = "None") -> Column:
    """Partner gene ``None`` means the gene itself."""
    return F.when(partner == empty, own).otherwise(partner)


def guide_key(*columns: str, sep: str = ":") -> Column:
    """Composite row key of the guides (P20)."""
    return F.concat_ws(sep, *columns)


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Column names that match a regex, for picking or dropping columns by name."""
    return [c for c in df.columns if re.search(pattern, c)]


def upper_ids(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.upper(c) for c in columns})


def flip_sign(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: -F.col(c) for c in columns})


def mirror(df: DataFrame) -> DataFrame:
    """Every construct in both orientations."""
    rest = [c for c in df.columns if c not in CONSTRUCT]
    swapped = df.select(
        F.col(GENE2).alias(GENE1),
        F.col(GENE1).alias(GENE2),
        F.col(GUIDE2).alias(GUIDE1),
        F.col(GUIDE1).alias(GUIDE2),
        *rest,
    )
    return df.select(*CONSTRUCT, *rest).unionByName(swapped)


def split_by_arity(df: DataFrame, control: str) -> dict[str, DataFrame]:
    """The three guide tables of a moderated comparison.

    combn: two different genes; dual: the same gene twice; single: one control and one gene.
    """
    c1, c2 = F.col(GENE1) == control, F.col(GENE2) == control
    return {
        "combn": df.where(~c1 & ~c2 & (F.col(GENE1) != F.col(GENE2))),
        "dual": df.where(~c1 & ~c2 & (F.col(GENE1) == F.col(GENE2))),
        "single": df.where(c1 != c2),
    }


def construct_ids(df: DataFrame, name: str = "pg_id") -> DataFrame:
    """Stable integer id per guide pair, from 1 without gaps (P10).

    A global ``row_number`` would sort the table on one task. Rows are counted per hash bucket of the guide key
    first (at most 65,536 buckets), and numbered by guide key inside their bucket after that.
    """
    from pyspark.sql import Window

    key = F.concat_ws("|", GUIDE1, GUIDE2)
    bucketed = df.withColumn("_key", key).withColumn("_bucket", F.substring(F.sha2("_key", 256), 1, 4))
    along = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_bucket").orderBy("_key")
    return (
        bucketed.join(F.broadcast(starts), "_bucket")
        .withColumn(name, F.col("_start") + F.row_number().over(inside))
        .drop("_key", "_bucket", "_start")
    )
