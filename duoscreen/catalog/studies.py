"""Queries of study preparation, score import, expression and alias sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from duoscreen.catalog.base import cte, query
from duoscreen.catalog.screens import CONTROL, IDS, _screen
from duoscreen.operators import filters, reshape
from duoscreen.plans import study
from duoscreen.sources import readers
from duoscreen.sources.lineitem_screen import LAYOUT, LINES, REPLICATES

# Study tables derived from the screen and the order lines, ids in lower case.

CONDITIONS = {"f": (["T0"], ["A", "R"]), "o": (["T0"], ["N", "R"])}
CONTROLS = ["ctrl", "g1"]

cte(
    "study_counts_in",
    " UNION ALL ".join(
        f"""SELECT lower(guide1) AS guide_1, lower(guide2) AS guide_2, lower(gene1) AS gene_1, lower(gene2) AS gene_2,
          concat_ws(';', t0, {s.lower()}_a, {s.lower()}_n, {s.lower()}_r) AS count_replicates, '{s.lower()}' AS cell_line_origin,
          'lines' AS study_origin, CASE WHEN t0 % 7 = 0 THEN 'T0;A' ELSE 'T0;A;N;R' END AS study_conditions FROM screen"""
        for s in LINES
    ),
)
cte(
    "study_scores_in",
    """SELECT lower(gene1) AS gene_1, lower(gene2) AS gene_2, 'lines' AS study_origin, lower(l_linestatus) AS cell_line_origin,
         avg(l_discount) - 0.05 AS SL_score, -0.0005::DOUBLE AS SL_score_cutoff, avg(l_tax) AS statistical_score,
         0.04::DOUBLE AS statistical_score_cutoff FROM (SELECT *,
            CASE WHEN l_partkey % 12 = 0 THEN 'CTRL' ELSE 'G' || lpad((l_partkey % 12)::VARCHAR, 2, '0') END AS gene1,
            CASE WHEN l_suppkey % 10 = 0 THEN 'CTRL' ELSE 'G' || lpad((l_suppkey % 10)::VARCHAR, 2, '0') END AS gene2 FROM lineitem)
       GROUP BY ALL""",
)


def _counts(spark, d):
    screen = _screen(spark, d)
    lines = F.array(
        *[
            F.struct(
                F.concat_ws(";", *[F.col(c).cast("string") for c in ("t0", *[f"{s}_{r}".lower() for r in REPLICATES])]).alias(
                    "count_replicates"
                ),
                F.lit(s.lower()).alias("cell_line_origin"),
            )
            for s in LINES
        ]
    )
    return (
        screen.withColumn("_l", F.explode(lines))
        .select(
            *[F.lower(a).alias(b) for a, b in zip(("guide1", "guide2", "gene1", "gene2"), ("guide_1", "guide_2", "gene_1", "gene_2"))],
            "_l.count_replicates",
            "_l.cell_line_origin",
            F.lit("lines").alias("study_origin"),
            F.when(F.col("t0") % 7 == 0, "T0;A").otherwise("T0;A;N;R").alias("study_conditions"),
        )
    )


def _scores_in(spark, d):
    def gene(key, n):
        number = F.col(key) % n
        return F.when(number == 0, "ctrl").otherwise(F.concat(F.lit("g"), F.lpad(number.cast("string"), 2, "0")))

    return (
        spark.read.parquet(f"{d}/lineitem.parquet")
        .groupBy(
            gene("l_partkey", 12).alias("gene_1"),
            gene("l_suppkey", 10).alias("gene_2"),
            F.lower("l_linestatus").alias("cell_line_origin"),
        )
        .agg((F.avg("l_discount") - 0.05).alias("SL_score"), F.avg("l_tax").alias("statistical_score"))
        .withColumns(
            {
                "study_origin": F.lit("lines"),
                "SL_score_cutoff": F.lit(-0.0005),
                "statistical_score_cutoff": F.lit(0.04),
            }
        )
    )


_label = """CASE WHEN SL_score <= -0.0005 AND statistical_score <= 0.04 THEN 'SL' ELSE 'Not SL' END AS SL_or_not"""
cte(
    "study_scores",
    f"""SELECT upper(gene_1) AS gene_1, upper(gene_2) AS gene_2, study_origin, upper(cell_line_origin) AS cell_line_origin, SL_score,
          SL_score_cutoff, statistical_score, statistical_score_cutoff,
          upper(least(gene_1, gene_2)) || '_' || upper(greatest(gene_1, gene_2)) AS gene_pair, {_label}
        FROM study_scores_in WHERE gene_1 <> gene_2 AND gene_1 NOT LIKE '%ctrl%' AND gene_2 NOT LIKE '%ctrl%'
          AND gene_1 NOT LIKE '%g1%' AND gene_2 NOT LIKE '%g1%'""",
)
_S = ["SL_score", "SL_score_cutoff", "statistical_score", "statistical_score_cutoff"]


@query("study_scores", "SELECT * FROM study_scores", _S)
def study_scores(spark, d):
    return study.prepare_scores(_scores_in(spark, d), CONTROLS)


@query(
    "sl_label",
    f"""SELECT gene_1, gene_2, cell_line_origin, {_label},
          CASE WHEN SL_score <= -0.0005 THEN 'SL' ELSE 'Not SL' END AS by_score,
          CASE WHEN statistical_score <= 0.04 THEN 'SL' ELSE 'Not SL' END AS by_statistic, 'Not SL' AS by_none FROM study_scores_in""",
)
def sl_label(spark, d):
    out = _scores_in(spark, d)
    cut = study.first_cutoffs(out)
    variants = {
        "SL_or_not": cut,
        "by_score": cut.withColumn("statistic", F.lit(0.0)),
        "by_statistic": cut.withColumn("score", F.lit(0.0)),
        "by_none": cut.select(F.lit(0.0).alias("score"), F.lit(0.0).alias("statistic")),
    }
    for name, cutoffs in variants.items():
        out = study.label_lethal(out, cutoffs).withColumnRenamed("SL_or_not", f"_{name}")
    return out.select("gene_1", "gene_2", "cell_line_origin", *[F.col(f"_{n}").alias(n) for n in variants])


cte(
    "study_counts",
    """SELECT upper(guide_1) AS guide_1, upper(guide_2) AS guide_2, upper(gene_1) AS gene_1, upper(gene_2) AS gene_2, count_replicates,
         upper(cell_line_origin) AS cell_line_origin, study_origin, study_conditions,
         CASE WHEN gene_1 <> 'ctrl' AND gene_2 <> 'ctrl' AND gene_1 <> gene_2 THEN 'Dual'
              WHEN gene_1 = 'ctrl' AND gene_2 = 'ctrl' THEN 'Control' ELSE 'Single' END AS target_type,
         split_part(count_replicates, ';', 1) AS T0_counts, 'T0' AS T0_replicate_names,
         CASE WHEN cell_line_origin = 'f' THEN split_part(count_replicates, ';', 2) ELSE split_part(count_replicates, ';', 3) END
           || ';' || split_part(count_replicates, ';', 4) AS TEnd_counts,
         CASE WHEN cell_line_origin = 'f' THEN 'A;R' ELSE 'N;R' END AS TEnd_replicate_names,
         upper(least(gene_1, gene_2)) || '|' || upper(greatest(gene_1, gene_2)) AS gene_pair,
         CASE WHEN gene_1 <= gene_2 THEN 'A_B' ELSE 'B_A' END AS gene_pair_orientation FROM study_counts_in""",
)


@query("study_counts", "SELECT * FROM study_counts")
def study_counts(spark, d):
    return study.prepare_counts(_counts(spark, d), CONTROLS, CONDITIONS)


@query(
    "scored_gene_filter",
    """SELECT c.* FROM study_counts c WHERE target_type = 'Control' OR (
         (gene_1 IN ('CTRL') OR EXISTS (SELECT 1 FROM study_scores s WHERE s.cell_line_origin = c.cell_line_origin AND c.gene_1 IN (s.gene_1, s.gene_2)))
         AND (gene_2 IN ('CTRL') OR EXISTS (SELECT 1 FROM study_scores s WHERE s.cell_line_origin = c.cell_line_origin AND c.gene_2 IN (s.gene_1, s.gene_2))))""",
)
def scored_gene_filter(spark, d):
    return filters.keep_scored_genes(study_counts(spark, d), study_scores(spark, d), "cell_line_origin", ("gene_1", "gene_2"), ["CTRL"])


@query(
    "study_sequences",
    """SELECT DISTINCT upper(guide_1) AS sgRNA_guide_name, upper('s' || guide_1) AS sgRNA_guide_seq,
         CASE WHEN gene_1 = 'ctrl' OR guide_1 = 'g05.1' THEN 'CONTROL' ELSE upper(gene_1) END AS sgRNA_target_name, 'lines' AS study_origin
       FROM study_counts_in""",
)
def study_sequences(spark, d):
    sequences = (
        _counts(spark, d)
        .select(
            F.col("guide_1").alias("sgRNA_guide_name"),
            F.concat(F.lit("s"), "guide_1").alias("sgRNA_guide_seq"),
            F.col("gene_1").alias("sgRNA_target_name"),
        )
        .distinct()
    )
    return study.prepare_sequences(sequences, ["ctrl", "g05.1"], "lines")


@query(
    "score_import",
    """SELECT upper(least(gene_1, gene_2)) || '_' || upper(greatest(gene_1, gene_2)) AS gene_pair,
         avg(-SL_score) FILTER (cell_line_origin = 'f') AS f, avg(-SL_score) FILTER (cell_line_origin = 'o') AS o
       FROM study_scores_in GROUP BY 1""",
    ["f", "o"],
)
def score_import(spark, d):
    upper = _scores_in(spark, d).withColumns({"gene_1": F.upper("gene_1"), "gene_2": F.upper("gene_2")})
    return study.import_scores(upper, "lines", ["f", "o"], "SL_score", ["SL_score"])


# alias table: symbols and former symbols from the supplier table

cte(
    "alias_in",
    """SELECT 'S' || s_suppkey AS symbol, CASE WHEN s_nationkey % 5 = 0 THEN '' ELSE 'N' || s_nationkey END AS gene_id,
         CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'S' || (2 * s_suppkey) || ', S' || (3 * s_suppkey) END AS previous FROM supplier""",
)
cte(
    "alias",
    """SELECT symbol, gene_id, trim(p) AS previous FROM (SELECT symbol, gene_id,
         unnest(CASE WHEN previous IS NULL THEN [NULL] ELSE string_split(previous, ',') END) AS p FROM alias_in WHERE gene_id <> '')""",
)

cte(
    "alias_first",
    """SELECT g.gene, a.gene_id FROM (SELECT DISTINCT 'S' || (2 * l_suppkey) AS gene FROM lineitem) g
       LEFT JOIN (SELECT DISTINCT symbol, gene_id FROM alias) a ON g.gene = a.symbol""",
)


def _aliases(spark, d):
    key = F.col("s_suppkey")

    def symbol(n):
        return F.concat(F.lit("S"), n.cast("string"))

    table = spark.read.parquet(f"{d}/supplier.parquet").select(
        symbol(key).alias("symbol"),
        F.when(F.col("s_nationkey") % 5 == 0, "").otherwise(F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("gene_id"),
        F.when(key % 3 != 0, F.concat_ws(", ", symbol(2 * key), symbol(3 * key))).alias("previous"),
    )
    return readers.alias_table(table, "symbol", "gene_id", "previous")


@query("alias_table", "SELECT symbol, gene_id, previous FROM alias")
def alias_table(spark, d):
    return _aliases(spark, d)


@query(
    "alias_lookup",
    """SELECT gene, gene_id FROM alias_first WHERE gene_id IS NOT NULL UNION ALL
       SELECT f.gene, a.gene_id FROM alias_first f LEFT JOIN (SELECT * FROM alias WHERE previous <> '') a ON f.gene = a.previous
       WHERE f.gene_id IS NULL""",
)
def alias_lookup(spark, d):
    genes = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.concat(F.lit("S"), (2 * F.col("l_suppkey")).cast("string")).alias("gene")
    )
    return readers.lookup_symbols(genes, _aliases(spark, d))


@query(
    "expression_matrix",
    """SELECT gene, sample, level >= 25.5 AS is_expressed FROM (
         SELECT 'LINE_F' AS model, 'F' AS sample, * FROM (SELECT 'SMALL' AS gene, avg(p_size) FILTER (p_type = 'SMALL') AS level FROM part WHERE p_partkey % 2 = 0
           UNION ALL SELECT 'LARGE', avg(p_size) FILTER (p_type = 'LARGE') FROM part WHERE p_partkey % 2 = 0)
         UNION ALL SELECT 'LINE_O', 'O', * FROM (SELECT 'SMALL' AS gene, avg(p_size) FILTER (p_type = 'SMALL') AS level FROM part WHERE p_partkey % 2 = 1
           UNION ALL SELECT 'LARGE', avg(p_size) FILTER (p_type = 'LARGE') FROM part WHERE p_partkey % 2 = 1))""",
)
def expression_matrix(spark, d):
    size = F.col("p_size").cast("double")
    matrix = (
        spark.read.parquet(f"{d}/part.parquet")
        .groupBy(F.when(F.col("p_partkey") % 2 == 0, "LINE_F").otherwise("LINE_O").alias("model"))
        .agg(
            F.avg(F.when(F.col("p_type") == "SMALL", size)).alias("SMALL..11."),
            F.avg(F.when(F.col("p_type") == "LARGE", size)).alias("LARGE..12."),
        )
    )
    return readers.expression_matrix(matrix, "model", {"LINE_F": "F", "LINE_O": "O"}, 25.5)


@query(
    "symbol_before_id",
    """SELECT DISTINCT 'G' || (p_partkey % 12) AS gene FROM part""",
)
def symbol_before_id(spark, d):
    entry = F.concat(F.lit("G"), (F.col("p_partkey") % 12).cast("string"), F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")"))
    parts = spark.read.parquet(f"{d}/part.parquet")
    return parts.select(readers.symbol_before_id(entry).alias("gene")).distinct()


@query(
    "flattened_gene_list",
    "SELECT DISTINCT unnest([p_name, p_brand, p_type]) AS gene FROM part",
)
def flattened_gene_list(spark, d):
    return readers.flatten_columns(spark.read.parquet(f"{d}/part.parquet").select("p_name", "p_brand", "p_type"))


@query("every_second_row", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 2 = 1")
def every_second_row(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_name")
    return readers.every_second_row(readers.require_columns(rows, ["s_suppkey"], "supplier"), "s_suppkey")


@query(
    "guide_annotation_join",
    f"SELECT {IDS}, 'lib-' || guide1 || '-' || guide2 AS library_id FROM screen",
)
def guide_annotation_join(spark, d):
    screen = _screen(spark, d).drop("gene1", "gene2")
    annotation = _screen(spark, d).select(
        "gene1", "gene2", "guide1", "guide2", F.concat_ws("-", F.lit("lib"), "guide1", "guide2").alias("library_id")
    )
    return screen.join(annotation, ["guide1", "guide2"]).select("gene1", "gene2", "guide1", "guide2", "library_id")


@query(
    "transposed_effects",
    " UNION ALL ".join(f"SELECT '{c}' AS rep, gene1, sum({c}) AS reads FROM screen GROUP BY gene1" for c in LAYOUT.late),
    ["reads"],
)
def transposed_effects(spark, d):
    by_gene = _screen(spark, d).groupBy("gene1").agg(*[F.sum(c).alias(c) for c in LAYOUT.late])
    return reshape.transpose(by_gene, "gene1", LAYOUT.late, ("rep", "reads"))


@query(
    "unmeasured_guides",
    "SELECT DISTINCT guide1 AS guide FROM screen EXCEPT SELECT DISTINCT guide2 FROM screen",
)
def unmeasured_guides(spark, d):
    screen = _screen(spark, d)
    return screen.select(F.col("guide1").alias("guide")).distinct().join(
        screen.select(F.col("guide2").alias("guide")).distinct(), "guide", "left_anti"
    )


@query("control_pair_filter", f"SELECT {IDS} FROM screen WHERE gene1 <> 'CTRL' AND gene2 <> 'CTRL'")
def control_pair_filter(spark, d):
    df = _screen(spark, d).withColumn("gene_pair", F.concat_ws("_", "gene1", "gene2"))
    return filters.drop_control_pairs(df, "gene_pair", CONTROL).select("gene1", "gene2", "guide1", "guide2")


CONTROL_NAMES = ["CTRL", "03", "G07.x"]


@query(
    "control_gene_filter",
    f"""SELECT {IDS} FROM screen WHERE NOT EXISTS (FROM (SELECT unnest({CONTROL_NAMES}) AS name)
          WHERE contains(name, gene1) OR contains(gene1, name) OR contains(name, gene2) OR contains(gene2, name))""",
)
def control_gene_filter(spark, d):
    return filters.drop_control_genes(_screen(spark, d), ["gene1", "gene2"], CONTROL_NAMES).select("gene1", "gene2", "guide1", "guide2")


@query("drop_empty_replicate", "SELECT guide1, guide2, f_a FROM screen", ["f_a"])
def drop_empty_replicate(spark, d):
    df = _screen(spark, d).select("guide1", "guide2", "f_a", F.lit(None).cast("double").alias("f_x"))
    return filters.drop_empty_replicates(df, ["f_a", "f_x"])
