"""Queries on the screen table itself: sources, labels, filters, normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from duoscreen.catalog.base import cte, query
from duoscreen.functions import labels, packed
from duoscreen.operators import filters, normalize, reshape, stats
from duoscreen.screen import CONSTRUCT, Layout
from duoscreen.session import stage
from duoscreen.sources.lineitem_screen import (
    ESSENTIALS,
    LAYOUT,
    LINES,
    REPLICATES,
    expression_from_part,
    screen_from_lineitem,
)

LATE = LAYOUT.late
COUNTS = ["t0", *LATE]
CONTROL = LAYOUT.control
IDS = ", ".join(CONSTRUCT)
TIMED = Layout(
    samples={"O": [f"o_{r}".lower() for r in REPLICATES]},
    t0="t0",
    control=CONTROL,
    mid={f"o_{r}".lower(): f"f_{r}".lower() for r in REPLICATES},
)


def essentials(spark, d):
    """Essential genes, as a one-column table derived from the part table."""
    number = F.col("p_partkey") % 12
    return (
        spark.read.parquet(f"{d}/part.parquet")
        .where(number.isin([int(g[1:]) for g in ESSENTIALS]))
        .select(F.concat(F.lit("G"), F.lpad(number.cast("string"), 2, "0")).alias("gene"))
        .distinct()
    )


def expression(spark, d):
    """Long expression flags ``(gene, sample, is_expressed)``."""
    from duoscreen.sources.readers import threshold_expression

    return threshold_expression(expression_from_part(spark, d), "gene", LINES, 25.5)


_counts = ", ".join(
    f"sum(CASE WHEN l_linestatus = '{s}' AND l_returnflag = '{r}' THEN l_quantity ELSE 0.0 END) AS {s.lower()}_{r.lower()}"
    for s in LINES
    for r in REPLICATES
)
cte(
    "screen",
    f"""
    SELECT gene1, gene2, gene1 || '.' || x1 AS guide1, gene2 || '.' || x2 AS guide2, sum(l_quantity) AS t0, {_counts}
    FROM (SELECT *,
            CASE WHEN l_partkey % 12 = 0 THEN 'CTRL' ELSE 'G' || lpad((l_partkey % 12)::VARCHAR, 2, '0') END AS gene1,
            CASE WHEN l_suppkey % 10 = 0 THEN 'CTRL' ELSE 'G' || lpad((l_suppkey % 10)::VARCHAR, 2, '0') END AS gene2,
            (l_orderkey % 6)::VARCHAR AS x1, (l_linenumber % 7)::VARCHAR AS x2 FROM lineitem)
    GROUP BY gene1, gene2, x1, x2""",
)
cte(
    "expression",
    """
    SELECT gene, 'F' AS sample, avg(p_size) >= 25.5 AS is_expressed FROM expression_parts GROUP BY gene
    UNION ALL
    SELECT gene, 'O', avg(p_size) FILTER (lot % 2 = 1) >= 25.5 FROM expression_parts GROUP BY gene""",
)
cte(
    "expression_parts",
    """
    SELECT 'G' || lpad((p_partkey % 12)::VARCHAR, 2, '0') AS gene, p_partkey // 12 AS lot, p_size::DOUBLE AS p_size
    FROM part WHERE p_partkey % 12 <> 0""",
)
cte("essential", "SELECT DISTINCT 'G' || lpad((p_partkey % 12)::VARCHAR, 2, '0') AS gene FROM part WHERE p_partkey % 12 IN (1, 2)")


def _screen(spark, d):
    return screen_from_lineitem(spark, d)


def _stored(spark, d):
    """The screen as a stored table, as a library would be, for scores that read it several times."""
    return stage(_screen(spark, d), "screen")


def _union(template: str, columns) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("screen_counts", f"SELECT {IDS}, {', '.join(COUNTS)} FROM screen", COUNTS)
def screen_counts(spark, d):
    return _screen(spark, d)


@query("library_size", _union("SELECT '{c}' AS sample, sum({c}) AS reads FROM screen", COUNTS), ["reads"])
def library_size(spark, d):
    return normalize.library_sizes(_screen(spark, d), COUNTS)


_rpm = "t0 * 1e6 / (SELECT sum(t0) FROM screen)"


@query(
    "rpm_mask",
    f"SELECT {IDS}, " + ", ".join(f"CASE WHEN NOT ({_rpm} < 150) THEN {c} END AS {c}" for c in COUNTS) + " FROM screen",
    COUNTS,
)
def rpm_mask(spark, d):
    return filters.mask_low_pool(_screen(spark, d), LAYOUT, 150.0)


@query("rpm_drop", f"SELECT * FROM screen WHERE {_rpm} >= 150", COUNTS)
def rpm_drop(spark, d):
    return filters.drop_low_pool(_screen(spark, d), LAYOUT, 150.0)


@query(
    "zero_mask",
    f"SELECT {IDS}, t0, f_a, f_n, f_r, "
    + ", ".join(f"CASE WHEN f_{r} = 0 OR o_{r} = 0 THEN NULL ELSE o_{r} END AS o_{r}" for r in "anr")
    + " FROM screen",
    COUNTS,
)
def zero_mask(spark, d):
    return filters.mask_zero_points(_screen(spark, d), TIMED)


@query("zero_to_null", f"SELECT {IDS}, t0, " + ", ".join(f"nullif({c}, 0) AS {c}" for c in LATE) + " FROM screen", COUNTS)
def zero_to_null(spark, d):
    return filters.zero_to_null(_screen(spark, d), LATE)


@query("exclude_types", f"SELECT * FROM screen WHERE gene1 <> 'CTRL' AND gene1 NOT SIMILAR TO '.*[57]$'", COUNTS)
def exclude_types(spark, d):
    return filters.exclude(_screen(spark, d), "gene1", ["CTRL"], ["[57]$"])


@query("read_window", "SELECT * FROM screen WHERE t0 BETWEEN 200 AND 400", COUNTS)
def read_window(spark, d):
    return filters.within_reads(_screen(spark, d), "t0", 200, 400)


@query("listed_gene_filter", "SELECT * FROM screen WHERE gene1 NOT IN ('CTRL', 'G03') AND gene2 NOT IN ('CTRL', 'G03')", COUNTS)
def listed_gene_filter(spark, d):
    return filters.drop_listed_genes(_screen(spark, d), ["CTRL", "G03"])


@query("drop_any_missing", "SELECT * FROM screen WHERE f_a <> 0 AND f_n <> 0 AND f_r <> 0 AND o_a <> 0 AND o_n <> 0 AND o_r <> 0", COUNTS)
def drop_any_missing(spark, d):
    return filters.drop_missing(filters.zero_to_null(_screen(spark, d), LATE), LATE)


# mean-scaled fold change

cte(
    "scaled",
    f"SELECT {IDS}, "
    + ", ".join(f"({c} + 5) / (SELECT avg({c} + 5) FROM screen) * 500 AS {c}" for c in COUNTS)
    + " FROM screen",
)
cte("scaled_lfc", f"SELECT {IDS}, " + ", ".join(f"log2({c} / t0) AS {c}" for c in LATE) + " FROM scaled")


@query("mean500", "SELECT * FROM scaled", COUNTS)
def mean500(spark, d):
    return normalize.mean_scaled(_screen(spark, d), COUNTS)


@query("mean500_lfc", "SELECT * FROM scaled_lfc", LATE)
def mean500_lfc(spark, d):
    scaled = normalize.mean_scaled(_screen(spark, d), COUNTS)
    return normalize.fold_changes(scaled, LAYOUT).drop("t0")


# plain fold change, zero counts missing

cte(
    "plain_lfc",
    f"SELECT {IDS}, " + ", ".join(f"log2(nullif({c}, 0) / nullif(t0, 0)) AS {c}" for c in LATE) + " FROM screen",
)


def _present_mean(cols) -> str:
    total = " + ".join(f"coalesce({c}, 0)" for c in cols)
    n = " + ".join(f"({c} IS NOT NULL)::INT" for c in cols)
    return f"({total}) / nullif({n}, 0)"


def _plain(spark, d):
    screen = filters.zero_to_null(_screen(spark, d), COUNTS)
    return normalize.fold_changes(screen, LAYOUT).drop("t0")


cte(
    "plain_means",
    "SELECT *, " + ", ".join(f'{_present_mean(c)} AS "{s}"' for s, c in LAYOUT.samples.items()) + " FROM plain_lfc",
)


@query("replicate_mean", f'SELECT {IDS}, "F", "O" FROM plain_means', LINES)
def replicate_mean(spark, d):
    return normalize.sample_means(_plain(spark, d), LAYOUT).select(*CONSTRUCT, *LINES)


@query(
    "replicate_mean_complete",
    f'SELECT {IDS}, (f_a + f_n + f_r) / 3 AS "F", (o_a + o_n + o_r) / 3 AS "O" FROM plain_lfc',
    LINES,
)
def replicate_mean_complete(spark, d):
    means = {s: normalize.row_mean_complete(c) for s, c in LAYOUT.samples.items()}
    return _plain(spark, d).withColumns(means).select(*CONSTRUCT, *LINES)


@query(
    "natural_log_lfc",
    f"SELECT {IDS}, " + ", ".join(f"ln(nullif({c}, 0) / t0) AS {c}" for c in LATE) + " FROM screen",
    LATE,
)
def natural_log_lfc(spark, d):
    return normalize.fold_changes(_screen(spark, d), LAYOUT, None).drop("t0")


@query("averaged_sides", f"SELECT {IDS}, t0, (f_a + f_n + f_r + o_a + o_n + o_r) / 6 AS tend FROM screen", ["t0", "tend"])
def averaged_sides(spark, d):
    return normalize.average_sides(_screen(spark, d), ["t0"], LATE).select(*CONSTRUCT, "t0", "tend")


# labels

cte(
    "classed",
    """
    SELECT s.*, e1.gene IS NOT NULL AS gene1_essential, e2.gene IS NOT NULL AS gene2_essential,
      CASE WHEN gene1 = 'CTRL' AND gene2 = 'CTRL' THEN 'NC'
           WHEN (gene1 = 'CTRL') <> (gene2 = 'CTRL') AND (e1.gene IS NOT NULL OR e2.gene IS NOT NULL) THEN 'PC'
           WHEN gene1 <> 'CTRL' AND gene2 <> 'CTRL' AND gene1 <> gene2 THEN 'DT' ELSE 'ST' END AS target_class
    FROM screen s LEFT JOIN essential e1 ON gene1 = e1.gene LEFT JOIN essential e2 ON gene2 = e2.gene""",
)


def _classed(spark, d):
    df, listed = _screen(spark, d), essentials(spark, d)
    df = labels.flag_members(labels.flag_members(df, "gene1", listed, "gene1_essential"), "gene2", listed, "gene2_essential")
    return df.withColumn(
        "target_class", labels.target_class(CONTROL, F.col("gene1_essential"), F.col("gene2_essential"))
    )


@query("target_class", f"SELECT {IDS}, gene1_essential, gene2_essential, target_class FROM classed")
def target_class(spark, d):
    return _classed(spark, d).select(*CONSTRUCT, "gene1_essential", "gene2_essential", "target_class")


@query(
    "target_class_by_origin",
    f"""SELECT {IDS}, CASE WHEN o = 'train' AND gene2 = 'CTRL' THEN 'PC'
      WHEN gene1 = 'CTRL' AND gene2 = 'CTRL' THEN 'NC' WHEN gene2 = 'CTRL' THEN 'ST' ELSE 'DT' END AS target_class
      FROM (SELECT *, CASE WHEN gene1 IN ('G01', 'G02') THEN 'train' ELSE 'other' END AS o FROM screen)""",
)
def target_class_by_origin(spark, d):
    origin = F.when(F.col("gene1").isin(ESSENTIALS), "train").otherwise("other")
    return _screen(spark, d).select(
        *CONSTRUCT, labels.target_class_by_origin(CONTROL, origin, "train").alias("target_class")
    )


_arity = """CASE WHEN gene1 = 'CTRL' AND gene2 = 'CTRL' THEN 'Control'
  WHEN gene1 = 'CTRL' OR gene2 = 'CTRL' OR gene1 = gene2 THEN 'Single' ELSE 'Dual' END"""


@query(
    "dual_single_control",
    f"""SELECT *, CASE WHEN arity = 'Single' AND gene1 = gene2 THEN 'Dual' ELSE arity END AS scored_arity
        FROM (SELECT {IDS}, {_arity} AS arity FROM screen)""",
)
def dual_single_control(spark, d):
    df = _screen(spark, d).select(*CONSTRUCT, labels.target_arity(CONTROL).alias("arity"))
    return df.withColumn("scored_arity", labels.same_gene_is_dual(F.col("arity")))


@query(
    "canonical_pair",
    """SELECT least(gene1, gene2) AS gene1, greatest(gene1, gene2) AS gene2,
         CASE WHEN gene1 < gene2 THEN guide1 ELSE guide2 END AS guide1,
         CASE WHEN gene1 < gene2 THEN guide2 ELSE guide1 END AS guide2,
         least(gene1, gene2) || '_' || greatest(gene1, gene2) AS gene_pair, t0 FROM screen""",
    ["t0"],
)
def canonical_pair(spark, d):
    df = labels.sort_positions(_screen(spark, d))
    return df.select(*CONSTRUCT, labels.pair_key(F.col("gene1"), F.col("gene2")).alias("gene_pair"), "t0")


@query(
    "orientation",
    f"""SELECT {IDS}, CASE WHEN gene1 <= gene2 THEN 'A_B' ELSE 'B_A' END AS ascending,
        CASE WHEN gene1 > gene2 THEN 'A_B' ELSE 'B_A' END AS descending FROM screen""",
)
def orientation(spark, d):
    return _screen(spark, d).select(
        *CONSTRUCT, labels.orientation(True).alias("ascending"), labels.orientation(False).alias("descending")
    )


@query(
    "split_construct_id",
    """SELECT construct, split_part(construct, ':', 1) AS left_part, split_part(construct, ':', 2) AS right_part,
         split_part(split_part(construct, ':', 1), '.', 1) AS gene1, split_part(split_part(construct, ':', 2), '.', 1) AS gene2
       FROM (SELECT guide1 || ':' || guide2 AS construct FROM screen)""",
)
def split_construct_id(spark, d):
    df = _screen(spark, d).select(labels.guide_key("guide1", "guide2").alias("construct"))
    df = labels.split_into(df, "construct", ":", ["left_part", "right_part"])
    df = labels.split_into(df, "left_part", "\\.", ["gene1", "_clone1"])
    return labels.split_into(df, "right_part", "\\.", ["gene2", "_clone2"]).drop("_clone1", "_clone2")


@query(
    "relabel_controls",
    """SELECT guide1, guide2, CASE WHEN gene1 IN ('G03') OR regexp_matches(gene1, '^G0[45]$') OR gene1 LIKE 'G1%'
         OR gene1 LIKE '%TR%' THEN 'NT' ELSE gene1 END AS gene1,
         CASE WHEN gene2 IN ('G01', 'G02') THEN 'NT' ELSE gene2 END AS gene2 FROM screen""",
)
def relabel_controls(spark, d):
    df = _screen(spark, d)
    gene = labels.relabel(F.col("gene1"), "NT", ["G03"], ["^G0[45]$"], contains=["TR"], prefixes=["G1"])
    relabelled = labels.relabel_members(df, "gene2", essentials(spark, d), "NT")
    return relabelled.select("guide1", "guide2", gene.alias("gene1"), "gene2")


@query(
    "construct_ids",
    """SELECT guide1, guide2, row_number() OVER (ORDER BY substr(sha256(guide1 || '|' || guide2), 1, 4),
         guide1 || '|' || guide2) AS pg_id FROM screen""",
)
def construct_ids(spark, d):
    return labels.construct_ids(_screen(spark, d).select(*CONSTRUCT)).select("guide1", "guide2", "pg_id")


@query(
    "single_guides",
    """SELECT gene1, gene2, CASE WHEN gene2 = 'CTRL' THEN guide1 WHEN gene1 = 'CTRL' THEN guide2 END AS targeting_guide,
         CASE WHEN gene2 = 'CTRL' THEN guide2 WHEN gene1 = 'CTRL' THEN guide1 END AS control_guide
       FROM classed WHERE target_class IN ('ST', 'PC')""",
)
def single_guides(spark, d):
    return _classed(spark, d).where(F.col("target_class").isin("ST", "PC")).select(
        "gene1",
        "gene2",
        labels.targeting_guide(CONTROL).alias("targeting_guide"),
        labels.control_guide(CONTROL).alias("control_guide"),
    )


@query(
    "fill_partner_upper",
    """SELECT guide1, guide2, upper(lower(gene1)) AS gene1,
         upper(CASE WHEN gene2 = 'CTRL' THEN gene1 ELSE gene2 END) AS gene2 FROM screen""",
)
def fill_partner_upper(spark, d):
    df = _screen(spark, d).withColumn("gene2", labels.fill_partner(F.col("gene2"), F.col("gene1"), CONTROL))
    return labels.upper_ids(df, ["gene1", "gene2"]).select("guide1", "guide2", "gene1", "gene2")


@query(
    "mirror_constructs",
    f"""SELECT {IDS}, t0 FROM screen UNION ALL
        SELECT gene2, gene1, guide2, guide1, t0 FROM screen""",
    ["t0"],
)
def mirror_constructs(spark, d):
    return labels.mirror(_screen(spark, d).select(*CONSTRUCT, "t0"))


@query(
    "arity_split",
    f"""SELECT {IDS}, CASE WHEN gene1 = 'CTRL' OR gene2 = 'CTRL' THEN 'single' WHEN gene1 = gene2 THEN 'dual' ELSE 'combn' END AS part
        FROM screen WHERE NOT (gene1 = 'CTRL' AND gene2 = 'CTRL')""",
)
def arity_split(spark, d):
    parts = labels.split_by_arity(_screen(spark, d).select(*CONSTRUCT), CONTROL)
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("part", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


@query(
    "pack_unpack_counts",
    f"""SELECT {IDS}, concat_ws(';', {', '.join(COUNTS)}) AS count_replicates,
         {', '.join(f'{c} AS c_{c}' for c in COUNTS)}, t0 AS t0_sum, f_a + f_r AS tend_sum FROM screen""",
    [*[f"c_{c}" for c in COUNTS], "t0_sum", "tend_sum"],
)
def pack_unpack_counts(spark, d):
    names = COUNTS
    df = _screen(spark, d).select(*CONSTRUCT, packed.pack(names).alias("count_replicates"))
    df = packed.unpack_columns(df, "count_replicates", [f"c_{n}" for n in names], 0.0)
    counts = packed.unpack(F.col("count_replicates"))

    def total(wanted):
        picked = packed.select_conditions(counts, F.array(*map(F.lit, names)), F.array(*map(F.lit, wanted)))
        return F.aggregate(picked, F.lit(0.0), lambda a, x: a + x)

    return df.withColumns({"t0_sum": total(["t0"]), "tend_sum": total(["f_a", "f_r", "absent"])})


@query(
    "low_count_guides",
    """SELECT guide, array_to_string(list_sort(list(DISTINCT rep)), ';') AS reps FROM (
         SELECT position, guide, rep FROM ("""
    + " UNION ALL ".join(
        f"SELECT {p} AS position, guide{p} AS guide, '{c}' AS rep, {c} AS v FROM screen" for p in (1, 2) for c in LATE
    )
    + ") GROUP BY position, guide, rep HAVING median(v) < 44) GROUP BY guide",
)
def low_count_guides(spark, d):
    low = filters.low_count_guides(_screen(spark, d), LATE, 44.0)
    return low.withColumn("reps", F.array_join("reps", ";"))


cte(
    "guide_median",
    "SELECT position, guide, rep, median(v) AS median_count FROM ("
    + " UNION ALL ".join(
        f"SELECT {p} AS position, guide{p} AS guide, '{c}' AS rep, {c} AS v FROM screen" for p in (1, 2) for c in LATE
    )
    + ") GROUP BY position, guide, rep",
)


@query("guide_medians", "SELECT position, guide, rep, median_count FROM guide_median", ["median_count"])
def guide_medians(spark, d):
    return filters.guide_medians(_screen(spark, d), LATE)


cte(
    "masked_screen",
    f"SELECT {IDS}, t0, "
    + ", ".join(
        f"""CASE WHEN guide1 IN (SELECT guide FROM guide_median WHERE rep = '{c}' AND median_count < 44)
            OR guide2 IN (SELECT guide FROM guide_median WHERE rep = '{c}' AND median_count < 44) THEN NULL ELSE {c} END AS {c}"""
        for c in LATE
    )
    + " FROM screen",
)


@query("low_guide_mask", f"SELECT {IDS}, {', '.join(LATE)} FROM masked_screen", LATE)
def low_guide_mask(spark, d):
    return filters.mask_low_count_guides(_screen(spark, d), LATE, 44.0).select(*CONSTRUCT, *LATE)


@query("expression_flags", "SELECT gene, sample, is_expressed FROM expression")
def expression_flags(spark, d):
    return expression(spark, d)


@query(
    "expression_join",
    f"""SELECT {IDS}, line.sample,
         coalesce(e1.is_expressed, CASE WHEN gene1 <> 'CTRL' THEN TRUE END)::VARCHAR AS gene1_expressed,
         coalesce(e2.is_expressed, CASE WHEN gene2 <> 'CTRL' THEN TRUE END)::VARCHAR AS gene2_expressed
       FROM screen, (VALUES ('F'), ('O')) line(sample) LEFT JOIN expression e1 ON gene1 = e1.gene AND line.sample = e1.sample
       LEFT JOIN expression e2 ON gene2 = e2.gene AND line.sample = e2.sample""",
)
def expression_join(spark, d):
    long = _screen(spark, d).select(*CONSTRUCT, F.explode(F.array(*map(F.lit, LINES))).alias("sample"))
    flags = normalize.attach_expression(long, expression(spark, d), CONTROL)
    return flags.withColumns({c: F.col(c).cast("string") for c in ("gene1_expressed", "gene2_expressed")})


@query(
    "rep_correlation",
    " UNION ALL ".join(
        f"SELECT '{b}_vs_{a}' AS comparison, corr({a}, {b}) AS r FROM plain_lfc WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a in enumerate(LATE)
        for b in LATE[i + 1 :]
    ),
    ["r"],
)
def rep_correlation(spark, d):
    return stats.column_correlations(_plain(spark, d), LATE)


@query(
    "gene_list",
    "SELECT DISTINCT gene FROM (SELECT gene1 AS gene FROM screen UNION ALL SELECT gene2 FROM screen)",
)
def gene_list(spark, d):
    return reshape.distinct_values(_screen(spark, d), ["gene1", "gene2"], "gene")


@query(
    "first_construct_per_pair",
    """SELECT gene1, gene2, guide1, guide2, t0 FROM (SELECT *, row_number() OVER (PARTITION BY gene1, gene2
         ORDER BY guide1, guide2) AS rn FROM screen) WHERE rn = 1""",
    ["t0"],
)
def first_construct_per_pair(spark, d):
    df = _screen(spark, d).select(*CONSTRUCT, "t0")
    return reshape.keep_first(df, ["gene1", "gene2"], ["guide1", "guide2"])
