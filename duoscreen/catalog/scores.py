"""Queries of the delta-fold-change, regression and quadratic scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from duoscreen.catalog.base import cte, query
from duoscreen.catalog.screens import CONTROL, IDS, _screen, _stored, essentials, expression
from duoscreen.operators import effects, filters, normalize, reshape, stats
from duoscreen.operators.ordered import bh_fdr
from duoscreen.plans import delta_lfc, quadratic_gi as quad, regression_gi as reg
from duoscreen.screen import CONSTRUCT, Layout
from duoscreen.session import stage
from duoscreen.sources.lineitem_screen import LAYOUT, LINES

LATE = LAYOUT.late


# delta fold change

cte(
    "lfc",
    " UNION ALL ".join(
        f"SELECT {IDS}, '{s}' AS sample, ({' + '.join(c)}) / {len(c)} AS lfc FROM scaled_lfc" for s, c in LAYOUT.samples.items()
    ),
)
cte(
    "smf_sides",
    """
    SELECT a.sample, a.gene, effect_a, effect_b FROM
      (SELECT sample, gene1 AS gene, avg(lfc) AS effect_a FROM lfc WHERE gene2 = 'CTRL' GROUP BY ALL) a LEFT JOIN
      (SELECT sample, gene2 AS gene, avg(lfc) AS effect_b FROM lfc WHERE gene1 = 'CTRL' GROUP BY ALL) b
      ON a.sample = b.sample AND a.gene = b.gene""",
)
cte("smf", "SELECT *, (effect_a + coalesce(effect_b, effect_a)) / 2 AS smf FROM smf_sides")
cte(
    "dlfc",
    """
    SELECT p.*, a.smf AS smf_a, b.smf AS smf_b, pair_median - (a.smf + b.smf) AS dlfc, gene_a || '_' || gene_b AS gene_pair
    FROM (SELECT least(gene1, gene2) AS gene_a, greatest(gene1, gene2) AS gene_b, sample, median(lfc) AS pair_median
          FROM lfc WHERE gene1 <> 'CTRL' AND gene2 <> 'CTRL' GROUP BY ALL) p
    LEFT JOIN smf a ON p.sample = a.sample AND gene_a = a.gene
    LEFT JOIN smf b ON p.sample = b.sample AND gene_b = b.gene""",
)
cte(
    "zd",
    """
    SELECT gene_pair, d.sample, dlfc, (dlfc - mu) / sd AS zdlfc FROM dlfc d JOIN (
      SELECT sample, avg(dlfc) AS mu, stddev_samp(dlfc) AS sd FROM dlfc JOIN (
        SELECT sample, quantile_cont(dlfc, 0.025) AS lo, quantile_cont(dlfc, 0.975) AS hi FROM dlfc WHERE dlfc IS NOT NULL GROUP BY sample)
      USING (sample) WHERE dlfc > lo AND dlfc < hi GROUP BY sample) m ON d.sample = m.sample WHERE dlfc IS NOT NULL""",
)


def _lfc(spark, d):
    return delta_lfc.sample_fold_changes(_screen(spark, d), LAYOUT)


def _lfc_stored(spark, d):
    return stage(_lfc(spark, d), "fold-changes")


@query("sample_lfc", f"SELECT {IDS}, sample, lfc FROM lfc", ["lfc"])
def sample_lfc(spark, d):
    return _lfc(spark, d)


@query("smf", "SELECT * FROM smf", ["effect_a", "effect_b", "smf"])
def smf(spark, d):
    return effects.gene_effects(_lfc_stored(spark, d), CONTROL)


@query(
    "smf_union",
    """SELECT coalesce(a.sample, b.sample) AS sample, coalesce(a.gene, b.gene) AS gene, effect_a, effect_b,
         CASE WHEN effect_a IS NULL THEN effect_b WHEN effect_b IS NULL THEN effect_a ELSE (effect_a + effect_b) / 2 END AS smf
       FROM (SELECT sample, gene1 AS gene, avg(lfc) AS effect_a FROM lfc WHERE gene2 = 'CTRL' GROUP BY ALL) a FULL JOIN
            (SELECT sample, gene2 AS gene, avg(lfc) AS effect_b FROM lfc WHERE gene1 = 'CTRL' GROUP BY ALL) b
       ON a.sample = b.sample AND a.gene = b.gene""",
    ["effect_a", "effect_b", "smf"],
)
def smf_union(spark, d):
    return effects.gene_effects(_lfc_stored(spark, d), CONTROL, positions="union")


@query(
    "smf_first_position",
    "SELECT sample, gene1 AS gene, avg(lfc) AS smf FROM lfc WHERE gene2 = 'CTRL' GROUP BY ALL",
    ["smf"],
)
def smf_first_position(spark, d):
    return effects.gene_effects(_lfc(spark, d), CONTROL, positions="first").select("sample", "gene", "smf")


@query("dlfc", "SELECT gene_pair, sample, pair_median, smf_a, smf_b, dlfc FROM dlfc", ["pair_median", "smf_a", "smf_b", "dlfc"])
def dlfc(spark, d):
    df = effects.delta_effects(_lfc_stored(spark, d), CONTROL)
    return df.select("gene_pair", "sample", "pair_median", "smf_a", "smf_b", "dlfc")


@query("zdlfc", "SELECT * FROM zd", ["dlfc", "zdlfc"])
def zdlfc(spark, d):
    return delta_lfc.zdlfc(_screen(spark, d), LAYOUT)


@query(
    "unscored_pairs",
    """SELECT least(gene1, gene2) || '_' || greatest(gene1, gene2) AS gene_pair, sample, median(lfc) AS pair_median
       FROM (SELECT * FROM lfc WHERE (gene1 = 'G05' OR gene2 = 'G05') AND gene1 <> 'CTRL' AND gene2 <> 'CTRL') GROUP BY ALL""",
    ["pair_median"],
)
def unscored_pairs(spark, d):
    lost = (F.col("gene1") == "G05") & (F.col("gene2") == CONTROL)
    return delta_lfc.unscored(_lfc_stored(spark, d).where(~lost), LAYOUT)


_kept_mean = ", ".join(f"({c} + 5) / (SELECT avg({c} + 5) FROM screen) * 500 AS {c}" for c in ["t0", *LATE])
cte("kscaled", f"SELECT {IDS}, {_kept_mean} FROM screen")
cte(
    "klfc",
    " UNION ALL ".join(
        f"SELECT {IDS}, '{s}' AS sample, ({' + '.join(f'log2({c} / t0)' for c in cols)}) / {len(cols)} AS lfc FROM kscaled WHERE gene1 <> gene2"
        for s, cols in LAYOUT.samples.items()
    ),
)
cte(
    "ksmf",
    """SELECT a.sample, a.gene, (ea + coalesce(eb, ea)) / 2 AS smf FROM
      (SELECT sample, gene1 AS gene, avg(lfc) AS ea FROM klfc WHERE gene2 = 'CTRL' GROUP BY ALL) a LEFT JOIN
      (SELECT sample, gene2 AS gene, avg(lfc) AS eb FROM klfc WHERE gene1 = 'CTRL' GROUP BY ALL) b ON a.sample = b.sample AND a.gene = b.gene""",
)
cte(
    "kdlfc",
    """SELECT ga || '_' || gb AS gene_pair, p.sample, m - (a.smf + b.smf) AS dlfc
       FROM (SELECT least(gene1, gene2) AS ga, greatest(gene1, gene2) AS gb, sample, median(lfc) AS m
             FROM klfc WHERE gene1 <> 'CTRL' AND gene2 <> 'CTRL' GROUP BY ALL) p
       JOIN ksmf a ON p.sample = a.sample AND ga = a.gene JOIN ksmf b ON p.sample = b.sample AND gb = b.gene""",
)


@query(
    "zdlfc_excluded",
    """SELECT gene_pair, d.sample, dlfc, (dlfc - mu) / sd AS zdlfc FROM kdlfc d JOIN (
         SELECT sample, avg(dlfc) AS mu, stddev_samp(dlfc) AS sd FROM kdlfc JOIN (
           SELECT sample, quantile_cont(dlfc, 0.025) AS lo, quantile_cont(dlfc, 0.975) AS hi FROM kdlfc GROUP BY sample)
         USING (sample) WHERE dlfc > lo AND dlfc < hi GROUP BY sample) m ON d.sample = m.sample""",
    ["dlfc", "zdlfc"],
)
def zdlfc_excluded(spark, d):
    """Constructs of a gene with itself count for the column means only."""
    return delta_lfc.zdlfc(_screen(spark, d), LAYOUT, keep=F.col("gene1") != F.col("gene2"))


@query("hits", "SELECT * FROM zd WHERE zdlfc < -1.5", ["dlfc", "zdlfc"])
def hits(spark, d):
    return filters.hits(zdlfc(spark, d), "zdlfc", -1.5)


@query(
    "pair_hits",
    "SELECT gene_pair, count(*) AS n_hits FROM zd WHERE zdlfc < -1.0 GROUP BY gene_pair",
)
def pair_hits(spark, d):
    return filters.pair_hits(zdlfc(spark, d), "gene_pair", "zdlfc", -1.0)


@query(
    "trimmed_z",
    """SELECT guide1, guide2, l.sample, lfc, (lfc - mu) / sd AS z FROM lfc l JOIN (
         SELECT sample, avg(lfc) AS mu, stddev_samp(lfc) AS sd FROM lfc JOIN (
           SELECT sample, quantile_cont(lfc, 0.025) AS lo, quantile_cont(lfc, 0.975) AS hi FROM lfc GROUP BY sample)
         USING (sample) WHERE lfc > lo AND lfc < hi GROUP BY sample) m ON l.sample = m.sample""",
    ["lfc", "z"],
)
def trimmed_z(spark, d):
    return stats.trimmed_z(_lfc_stored(spark, d).select("guide1", "guide2", "sample", "lfc"), "lfc", name="z")


cte(
    "position_r",
    """SELECT sample, corr(effect_a, effect_b) AS r, count(*) AS n FROM smf_sides
       WHERE effect_a IS NOT NULL AND effect_b IS NOT NULL GROUP BY sample""",
)


def p_sql(t: str, df: str, points: int = 2000) -> str:
    """Two-sided t probability by Simpson's rule over the angle atan(u / sqrt(df)); an independent formula."""
    weight = f"CASE WHEN i = 0 OR i = {points} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    end = f"atan(abs({t}) / sqrt({df}))"
    area = (
        f"list_sum(list_transform(range(0, {points} + 1), lambda i: ({weight}) * pow(cos({end} * i / {points}), {df} - 1)))"
        f" * {end} / {points} / 3"
    )
    scale = f"exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi())"
    return f"(1 - 2 * ({scale}) * ({area}))"


@query(
    "position_correlation",
    f"""SELECT sample, r, n, {p_sql('t', 'df')} AS p_val FROM (
          SELECT *, (n - 2)::DOUBLE AS df, r * sqrt((n - 2) / (1 - r * r)) AS t FROM position_r)""",
    ["r", "p_val"],
)
def position_correlation(spark, d):
    both = effects.gene_effects(_lfc_stored(spark, d), CONTROL).where(
        F.col("effect_a").isNotNull() & F.col("effect_b").isNotNull()
    )
    r = both.groupBy("sample").agg(F.corr("effect_a", "effect_b").alias("r"), F.count(F.lit(1)).alias("n"))
    return r.withColumn("p_val", stats.correlation_p(F.col("r"), F.col("n")))


cte(
    "hist_ends",
    "SELECT sample, min(lfc) AS lo, max(lfc) AS hi FROM lfc GROUP BY sample",
)


@query(
    "lfc_histogram",
    """SELECT sample, bin, count(*) AS n, max(lo + bin * (hi - lo) / 30) AS bin_start, max(lo + (bin + 1) * (hi - lo) / 30) AS bin_end
       FROM (SELECT sample, lo, hi, least(floor((lfc - lo) / ((hi - lo) / 30)), 29)::INT AS bin FROM lfc JOIN hist_ends USING (sample))
       GROUP BY sample, bin""",
    ["bin_start", "bin_end"],
)
def lfc_histogram(spark, d):
    return stats.histogram(_lfc_stored(spark, d), "lfc", "sample")


@query(
    "kde_grid",
    """SELECT sample, point::INT AS point, x, sum(exp(-0.5 * ((x - zdlfc) / h) * ((x - zdlfc) / h))) / (max(n) * max(h) * sqrt(2 * pi())) AS density,
         exp(-0.5 * x * x) / sqrt(2 * pi()) AS normal
       FROM (SELECT sample, zdlfc, n, h FROM zd JOIN (SELECT sample, count(*) AS n, stddev_samp(zdlfc) * count(*) ** (-0.2) AS h
             FROM zd GROUP BY sample) USING (sample)),
            (SELECT range AS point, -10 + range * (20.0::DOUBLE / 499) AS x FROM range(500))
       GROUP BY sample, point, x""",
    ["x", "density", "normal"],
)
def kde_grid(spark, d):
    return stats.gaussian_kde(stage(zdlfc(spark, d), "scores"), "zdlfc", "sample")


@query(
    "lines_full_outer",
    """SELECT coalesce(a.gene_pair, b.gene_pair) AS gene_pair, a.zdlfc AS "F", b.zdlfc AS "O"
       FROM (SELECT * FROM zd WHERE sample = 'F' AND zdlfc < 0.5) a FULL JOIN
            (SELECT * FROM zd WHERE sample = 'O' AND zdlfc > -0.5) b ON a.gene_pair = b.gene_pair""",
    ["F", "O"],
)
def lines_full_outer(spark, d):
    z = stage(zdlfc(spark, d), "scores")
    parts = {
        "F": z.where((F.col("sample") == "F") & (F.col("zdlfc") < 0.5)),
        "O": z.where((F.col("sample") == "O") & (F.col("zdlfc") > -0.5)),
    }
    return reshape.full_outer(parts, "gene_pair", "zdlfc")


@query("lines_stacked", "SELECT gene_pair, sample, zdlfc FROM zd", ["zdlfc"])
def lines_stacked(spark, d):
    z = stage(zdlfc(spark, d), "scores")
    return reshape.stack_scores({s: z.where(F.col("sample") == s) for s in LINES}, "gene_pair", "zdlfc")


@query(
    "zdlfc_wide",
    """SELECT gene_pair, max(zdlfc) FILTER (sample = 'F') AS "F", max(zdlfc) FILTER (sample = 'O') AS "O" FROM zd GROUP BY gene_pair""",
    ["F", "O"],
)
def zdlfc_wide(spark, d):
    return reshape.widen(zdlfc(spark, d), ["gene_pair"], "sample", LINES, {"": "zdlfc"})


@query("zdlfc_ordered", "SELECT gene_pair, sample, zdlfc FROM zd", ["zdlfc"])
def zdlfc_ordered(spark, d):
    return zdlfc(spark, d).select("gene_pair", "sample", "zdlfc").orderBy("sample", "zdlfc")


# regression residual score: the cell lines and their replicates are scored

OPTIONS = reg.Options(all_reps=True)
OBSERVED = reg.Options(all_reps=True, expected="observed", scale_controls=False, sort_genes=True)
REPS = LINES + LATE

cte(
    "rlong",
    f"""SELECT {IDS}, target_class, gene1 || '_' || gene2 AS paralog_pair, rep, upper(rep[1:1]) AS sample, lfc FROM (
          SELECT * FROM (SELECT c.gene1, c.gene2, c.guide1, c.guide2, target_class, """
    + ", ".join(f'm."{r}"' for r in REPS)
    + """ FROM classed c JOIN plain_means m USING (guide1, guide2)) UNPIVOT (lfc FOR rep IN ("""
    + ", ".join(f'"{r}"' for r in REPS)
    + ")))",
)
cte(
    "rscaled",
    """SELECT l.*, lfc - nc AS lfc_centred, (lfc - nc) / nullif(nc - pc, 0) AS lfc_scaled FROM rlong l JOIN (
         SELECT rep, median(CASE WHEN target_class = 'NC' THEN lfc END) AS nc, median(CASE WHEN target_class = 'PC' THEN lfc END) AS pc
         FROM rlong GROUP BY rep) m USING (rep)""",
)
cte(
    "rflagged",
    """SELECT *, CASE WHEN target_class IN ('ST', 'PC') THEN 'single' WHEN target_class = 'DT' THEN 'double' ELSE 'control' END AS grp,
         CASE WHEN target_class IN ('ST', 'PC') THEN (gene2 = 'CTRL' AND NOT x1) OR (gene1 = 'CTRL' AND NOT x2)
              WHEN target_class = 'DT' THEN NOT x1 AND NOT x2 ELSE FALSE END AS ref
       FROM (SELECT s.*, coalesce(e1.is_expressed, TRUE) AS x1, coalesce(e2.is_expressed, TRUE) AS x2 FROM rscaled s
         LEFT JOIN expression e1 ON gene1 = e1.gene AND s.sample = e1.sample
         LEFT JOIN expression e2 ON gene2 = e2.gene AND s.sample = e2.sample)""",
)
cte(
    "rscore",
    """SELECT f.*, CASE WHEN f.grp = 'control' THEN lfc_scaled ELSE lfc_scaled - centre END AS cs FROM rflagged f LEFT JOIN (
         SELECT rep, grp, median(lfc_scaled) AS centre FROM rflagged WHERE ref GROUP BY rep, grp) m
       ON f.rep = m.rep AND f.grp = m.grp""",
)
cte(
    "rsingle",
    """SELECT *, CASE WHEN gene1 = 'CTRL' THEN gene2 ELSE gene1 END AS targeted_gene,
         CASE WHEN gene2 = 'CTRL' THEN guide1 WHEN gene1 = 'CTRL' THEN guide2 END AS targeting_guide,
         CASE WHEN gene2 = 'CTRL' THEN guide2 WHEN gene1 = 'CTRL' THEN guide1 END AS control_guide
       FROM rscore WHERE target_class IN ('ST', 'PC') AND cs IS NOT NULL""",
)
cte(
    "rmean_single",
    "SELECT rep, paralog_pair, targeting_guide, avg(cs) AS mean_single_score FROM rsingle GROUP BY ALL",
)
cte(
    "rdouble",
    """SELECT d.rep, d.paralog_pair, d.guide1, d.guide2, d.cs AS observed_score, a.mean_single_score AS mean_single1,
         b.mean_single_score AS mean_single2, a.mean_single_score + b.mean_single_score AS expected_score
       FROM rscore d LEFT JOIN rmean_single a ON d.rep = a.rep AND d.guide1 = a.targeting_guide
       LEFT JOIN rmean_single b ON d.rep = b.rep AND d.guide2 = b.targeting_guide WHERE target_class = 'DT'""",
)
cte(
    "rcontrol",
    """SELECT rep, control_guide, avg(cs) AS mean_control_score FROM (
         SELECT rep, guide1 AS control_guide, cs FROM rscore WHERE target_class = 'NC' UNION ALL
         SELECT rep, guide2, cs FROM rscore WHERE target_class = 'NC') GROUP BY ALL""",
)
cte(
    "rmatch",
    """SELECT s.rep, s.paralog_pair, s.targeting_guide, s.targeted_gene, s.control_guide, s.cs AS o, t.cs AS other,
         mean_control_score, t.cs + mean_control_score AS e
       FROM rsingle s JOIN rsingle t ON s.rep = t.rep AND s.paralog_pair = t.paralog_pair
         AND s.targeting_guide = t.targeting_guide AND s.control_guide <> t.control_guide
       LEFT JOIN rcontrol c ON s.rep = c.rep AND s.control_guide = c.control_guide""",
)
cte(
    "rtarget",
    "SELECT rep, targeted_gene, avg(e) AS mean_expected, avg(o) AS mean_observed FROM rmatch WHERE e IS NOT NULL GROUP BY ALL",
)
cte(
    "rfit",
    """SELECT rep, regr_slope(mean_observed, mean_expected) AS slope, regr_intercept(mean_observed, mean_expected) AS intercept
       FROM rtarget GROUP BY rep""",
)
cte(
    "rdouble_gi",
    """SELECT d.*, observed_score - (intercept + slope * expected_score) AS gi_score FROM rdouble d JOIN rfit USING (rep)
       WHERE mean_single1 IS NOT NULL AND mean_single2 IS NOT NULL""",
)
cte("rsingle_gi", "SELECT m.*, o - (intercept + slope * e) AS gi FROM rmatch m JOIN rfit USING (rep) WHERE e IS NOT NULL")
cte(
    "rwelch",
    """SELECT rep, paralog_pair, t, se4 / (a * a / (pn - 1) + b * b / (n - 1)) AS df FROM (
         SELECT rep, paralog_pair, n, pn, pv / pn AS a, v / n AS b, (pm - m) / sqrt(pv / pn + v / n) AS t, (pv / pn + v / n) ** 2 AS se4
         FROM (SELECT rep, paralog_pair, count(gi_score) AS n, avg(gi_score) AS m, var_samp(gi_score) AS v FROM rdouble_gi GROUP BY ALL)
         JOIN (SELECT rep, count(gi) AS pn, avg(gi) AS pm, var_samp(gi) AS pv FROM rsingle_gi GROUP BY rep) USING (rep))""",
)
cte("rp", f"SELECT *, {p_sql('t', 'df')} AS p_val FROM rwelch")
cte(
    "rfdr",
    """SELECT *, least(1.0, min(q) OVER (PARTITION BY rep ORDER BY p_val DESC, rn DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM (
         SELECT *, p_val * count(p_val) OVER (PARTITION BY rep) / rn AS q FROM (
           SELECT *, row_number() OVER (PARTITION BY rep ORDER BY p_val) AS rn FROM rp WHERE p_val IS NOT NULL))""",
)
cte(
    "rpairs",
    """SELECT d.rep, d.paralog_pair, mean_observed, mean_expected, mean_gi, 'double' AS broad_class, p_val, fdr FROM (
         SELECT rep, paralog_pair, avg(observed_score) AS mean_observed, avg(expected_score) AS mean_expected,
           avg(gi_score) AS mean_gi FROM rdouble_gi GROUP BY ALL) d
       LEFT JOIN rfdr f ON d.rep = f.rep AND d.paralog_pair = f.paralog_pair
       UNION ALL SELECT rep, paralog_pair, avg(o), avg(e), avg(gi), 'single', NULL, NULL FROM rsingle_gi GROUP BY rep, paralog_pair""",
)


def _long(spark, d, options=OPTIONS):
    return reg.long_fold_changes(_screen(spark, d), LAYOUT, essentials(spark, d), options)


def _long_stored(spark, d):
    return stage(_long(spark, d), "long")


def _scores(spark, d, options=OPTIONS):
    return stage(reg.crispr_scores(_long(spark, d, options), expression(spark, d), LAYOUT, options), "crispr-scores")


def _residuals(spark, d):
    return reg.residuals(_scores(spark, d), LAYOUT, OPTIONS)


@query("long_lfc", f"SELECT {IDS}, target_class, paralog_pair, rep, sample, lfc FROM rlong", ["lfc"])
def long_lfc(spark, d):
    return _long(spark, d)


@query(
    "control_scale",
    f"SELECT {IDS}, rep, lfc_centred, lfc_scaled FROM rscaled",
    ["lfc_centred", "lfc_scaled"],
)
def control_scale(spark, d):
    return normalize.control_scaled(_long_stored(spark, d)).select(*CONSTRUCT, "rep", "lfc_centred", "lfc_scaled")


@query("class_medians", "SELECT rep, target_class, median(lfc) AS median_lfc FROM rlong GROUP BY ALL", ["median_lfc"])
def class_medians(spark, d):
    from duoscreen.operators.ordered import exact_quantiles

    return exact_quantiles(_long_stored(spark, d), ["rep", "target_class"], "lfc", {"median_lfc": 0.5}).drop("n")


@query("unexpressed_recentre", f"SELECT {IDS}, rep, target_class, cs AS crispr_score FROM rscore", ["crispr_score"])
def unexpressed_recentre(spark, d):
    scaled = normalize.control_scaled(_long_stored(spark, d))
    flagged = stage(normalize.attach_expression(scaled, expression(spark, d), CONTROL), "flagged")
    df = normalize.unexpressed_recentred(flagged, CONTROL)
    return df.select(*CONSTRUCT, "rep", "target_class", "crispr_score")


@query("crispr_scores", f"SELECT {IDS}, rep, cs AS crispr_score FROM rscore", ["crispr_score"])
def crispr_scores(spark, d):
    return _scores(spark, d).select(*CONSTRUCT, "rep", "crispr_score")


@query("rows_per_rep", "SELECT rep, count(*) AS n FROM rlong GROUP BY rep")
def rows_per_rep(spark, d):
    return _long(spark, d).groupBy("rep").agg(F.count(F.lit(1)).alias("n"))


@query("single_guide_mean", "SELECT * FROM rmean_single", ["mean_single_score"])
def single_guide_mean(spark, d):
    return reg.single_guide_means(_scores(spark, d), CONTROL)


@query("control_guide_mean", "SELECT * FROM rcontrol", ["mean_control_score"])
def control_guide_mean(spark, d):
    return reg.control_guide_means(_scores(spark, d))


@query(
    "other_control",
    """SELECT rep, paralog_pair, targeting_guide, control_guide, count(*) AS n_pairs, avg(other) AS mean_other,
         sum(other * other) AS sq_other_all FROM rmatch GROUP BY ALL""",
    ["mean_other", "sq_other_all"],
)
def other_control(spark, d):
    df = reg.other_control_moments(_scores(spark, d), CONTROL)
    return df.select(
        "rep",
        "paralog_pair",
        "targeting_guide",
        "control_guide",
        (F.col("n_own") * F.col("n_other")).alias("n_pairs"),
        "mean_other",
        (F.col("n_own") * (F.col("m2_other") + F.col("n_other") * F.col("mean_other") * F.col("mean_other"))).alias("sq_other_all"),
    )


@query(
    "double_expected",
    "SELECT rep, guide1, guide2, observed_score, mean_single1, mean_single2, expected_score FROM rdouble",
    ["observed_score", "mean_single1", "mean_single2", "expected_score"],
)
def double_expected(spark, d):
    df = reg.double_expected(_scores(spark, d), CONTROL)
    return df.select("rep", "guide1", "guide2", "observed_score", "mean_single1", "mean_single2", "expected_score")


@query(
    "removed_audit",
    """SELECT 'double' AS kind, rep, guide1 AS one, guide2 AS two, count(*) AS n FROM rdouble
         WHERE mean_single1 IS NULL OR mean_single2 IS NULL GROUP BY ALL
       UNION ALL SELECT 'single', rep, targeting_guide, control_guide, count(*) FROM rmatch WHERE e IS NULL GROUP BY ALL
       UNION ALL SELECT 'no score', rep, guide1, guide2, 1 FROM (
         SELECT r.rep, guide1, guide2 FROM (SELECT DISTINCT guide1, guide2 FROM screen), (SELECT unnest(['F', 'O']) AS rep) r
         EXCEPT SELECT rep, guide1, guide2 FROM rlong WHERE rep IN ('F', 'O'))""",
)
def removed_audit(spark, d):
    scores = _scores(spark, d)
    n = F.count(F.lit(1)).alias("n")
    doubles = filters.removed_rows(reg.double_expected(scores, CONTROL), ["mean_single1", "mean_single2"])
    singles = filters.removed_rows(reg.single_expected(scores, CONTROL), ["mean_control_score"])
    wide = reg.fold_change_table(_screen(spark, d), LAYOUT, essentials(spark, d), OPTIONS)
    missing = normalize.to_long(wide, ["guide1", "guide2"], LINES, "rep", "lfc").where(F.col("lfc").isNull())
    return (
        doubles.groupBy(F.lit("double").alias("kind"), "rep", F.col("guide1").alias("one"), F.col("guide2").alias("two"))
        .agg(n)
        .unionByName(
            singles.groupBy(
                F.lit("single").alias("kind"),
                "rep",
                F.col("targeting_guide").alias("one"),
                F.col("control_guide").alias("two"),
            ).agg(F.sum("n_pairs").alias("n"))
        )
        .unionByName(
            missing.groupBy(F.lit("no score").alias("kind"), "rep", F.col("guide1").alias("one"), F.col("guide2").alias("two")).agg(n)
        )
    )


@query("target_means", "SELECT * FROM rtarget", ["mean_expected", "mean_observed"])
def target_means(spark, d):
    return reg.target_means(reg.single_expected(_scores(spark, d), CONTROL))


@query("expected_observed_lm", "SELECT * FROM rfit", ["slope", "intercept"])
def expected_observed_lm(spark, d):
    return reg.single_fit(reg.single_expected(_scores(spark, d), CONTROL))


@query("gi_double", "SELECT rep, paralog_pair, guide1, guide2, gi_score FROM rdouble_gi", ["gi_score"])
def gi_double(spark, d):
    return _residuals(spark, d)[0].select("rep", "paralog_pair", "guide1", "guide2", "gi_score")


@query(
    "gi_single",
    """SELECT rep, paralog_pair, targeting_guide, control_guide, count(*) AS n_pairs, avg(gi) AS mean_gi, sum(gi * gi) AS sum_gi2
       FROM rsingle_gi GROUP BY ALL""",
    ["mean_gi", "sum_gi2"],
)
def gi_single(spark, d):
    sum_gi2 = F.col("m2_gi") + F.col("n_pairs") * F.col("mean_gi") * F.col("mean_gi")
    return _residuals(spark, d)[1].select(
        "rep", "paralog_pair", "targeting_guide", "control_guide", "n_pairs", "mean_gi", sum_gi2.alias("sum_gi2")
    )


@query("welch_t", "SELECT rep, paralog_pair, t, df FROM rwelch", ["t", "df"])
def welch_t(spark, d):
    doubles, singles = _residuals(spark, d)
    pairs = stats.moments(doubles, ["rep", "paralog_pair"], "gi_score", "pair")
    pool = reg.single_pool(singles)
    joined = pairs.join(F.broadcast(pool), "rep").withColumns(stats.welch("pool", "pair"))
    return joined.select("rep", "paralog_pair", "t", "df")


@query("welch_p", "SELECT rep, paralog_pair, p_val FROM rp", ["p_val"])
def welch_p(spark, d):
    return reg.pair_tests(*_residuals(spark, d)).select("rep", "paralog_pair", "p_val")


@query(
    "bh_fdr",
    "SELECT p.rep, p.paralog_pair, p.p_val, fdr FROM rp p LEFT JOIN rfdr f ON p.rep = f.rep AND p.paralog_pair = f.paralog_pair",
    ["p_val", "fdr"],
)
def pair_fdr(spark, d):
    return reg.pair_tests(*_residuals(spark, d)).select("rep", "paralog_pair", "p_val", "fdr")


@query("regression_pairs", "SELECT * FROM rpairs", ["mean_observed", "mean_expected", "mean_gi", "p_val", "fdr"])
def regression_pairs(spark, d):
    pairs = reg.regression_gi(_screen(spark, d), LAYOUT, essentials(spark, d), expression(spark, d), OPTIONS)
    return pairs.drop("gene1", "gene2")


@query(
    "regression_wide",
    """SELECT least(split_part(paralog_pair, '_', 1), split_part(paralog_pair, '_', 2)) || '_' ||
         greatest(split_part(paralog_pair, '_', 1), split_part(paralog_pair, '_', 2)) AS paralog_pair, """
    + ", ".join(
        f"max({v}) FILTER (rep = '{s}') AS \"{out}_{s}\""
        for out, v in (("gi", "mean_gi"), ("fdr", "fdr"), ("p_val", "p_val"))
        for s in LINES
    )
    + " FROM (SELECT *, paralog_pair AS pp FROM rpairs WHERE broad_class = 'double') GROUP BY pp, paralog_pair",
    [f"{out}_{s}" for out in ("gi", "fdr", "p_val") for s in LINES],
)
def regression_wide(spark, d):
    pairs = reg.regression_gi(_screen(spark, d), LAYOUT, essentials(spark, d), expression(spark, d), OPTIONS)
    return reg.wide_pairs(pairs, LAYOUT)


# the variant without other controls: expected = observed, no control scaling, genes in alphabetical order

cte(
    "vlong",
    """SELECT least(gene1, gene2) AS gene1, greatest(gene1, gene2) AS gene2, least(gene1, gene2) || '_' || greatest(gene1, gene2) AS paralog_pair,
         CASE WHEN gene1 < gene2 THEN guide1 ELSE guide2 END AS guide1, CASE WHEN gene1 < gene2 THEN guide2 ELSE guide1 END AS guide2,
         target_class, rep, lfc, grp, ref FROM rflagged""",
)
cte(
    "vscore",
    """SELECT f.*, CASE WHEN f.grp = 'control' THEN lfc ELSE lfc - centre END AS cs FROM vlong f LEFT JOIN (
         SELECT rep, grp, median(lfc) AS centre FROM vlong WHERE ref GROUP BY rep, grp) m ON f.rep = m.rep AND f.grp = m.grp""",
)
cte(
    "vmean",
    """SELECT rep, paralog_pair, CASE WHEN gene2 = 'CTRL' THEN guide1 WHEN gene1 = 'CTRL' THEN guide2 END AS g, avg(cs) AS m
       FROM vscore WHERE target_class IN ('ST', 'PC') GROUP BY ALL""",
)
cte(
    "vfit",
    """SELECT rep, regr_slope(y, y) AS slope, regr_intercept(y, y) AS intercept FROM (
         SELECT rep, CASE WHEN gene1 = 'CTRL' THEN gene2 ELSE gene1 END AS gene, avg(cs) AS y
         FROM vscore WHERE target_class IN ('ST', 'PC') GROUP BY ALL) GROUP BY rep""",
)


@query(
    "observed_mode_gi",
    """SELECT d.rep, d.paralog_pair, avg(d.cs) AS mean_observed, avg(a.m + b.m) AS mean_expected,
         avg(d.cs - (intercept + slope * (a.m + b.m))) AS mean_gi
       , 'double' AS broad_class FROM vscore d JOIN vmean a ON d.rep = a.rep AND d.guide1 = a.g JOIN vmean b ON d.rep = b.rep AND d.guide2 = b.g
       JOIN vfit f ON d.rep = f.rep WHERE target_class = 'DT' GROUP BY ALL
       UNION ALL SELECT v.rep, paralog_pair, avg(cs), avg(cs), avg(cs - (intercept + slope * cs)), 'single'
       FROM vscore v JOIN vfit f ON v.rep = f.rep WHERE target_class IN ('ST', 'PC') AND cs IS NOT NULL GROUP BY ALL""",
    ["mean_observed", "mean_expected", "mean_gi"],
)
def observed_mode_gi(spark, d):
    pairs = reg.regression_gi(_screen(spark, d), LAYOUT, essentials(spark, d), expression(spark, d), OBSERVED)
    return pairs.select("rep", "paralog_pair", "mean_observed", "mean_expected", "mean_gi", "broad_class")


# quadratic-fit score

def _fc_sql(source: str) -> str:
    """Depth-adjusted fold changes; a missing replicate stays out of both depth sums."""
    return ", ".join(
        f"""log2(("{c}" + 10) / (t0 + 10) / (SELECT sum(t0 + 10) / sum("{c}" + 10) FROM {source} WHERE "{c}" IS NOT NULL)) AS "{c}\""""
        for c in LINES
    )


def _quad_sql(rows: str, query_guide: str, x: str, b: str) -> str:
    return f"""SELECT sample, guide, CASE WHEN lo <> hi THEN (t2 * s2 - t1 * s3) / (s4 * s2 - s3 * s3) ELSE 0 END AS m0,
         CASE WHEN lo <> hi THEN (s4 * t1 - s3 * t2) / (s4 * s2 - s3 * s3) ELSE coalesce(t1 / nullif(s2, 0), 0) END AS m1 FROM (
         SELECT sample, {query_guide} AS guide, sum({x} ** 2) AS s2, sum({x} ** 3) AS s3, sum({x} ** 4) AS s4,
           sum({x} * (fc - {b})) AS t1, sum({x} ** 2 * (fc - {b})) AS t2, min(nullif({x}, 0)) AS lo, max(nullif({x}, 0)) AS hi
         FROM {rows} GROUP BY ALL)"""


def _quadratic_ctes(q: str, source: str) -> None:
    """All steps of the score over one source table, under names that start with ``q``."""
    cte(
        f"{q}raw",
        f"""SELECT {IDS}, CASE WHEN gene1 = 'CTRL' AND gene2 = 'CTRL' THEN 'Control' WHEN gene1 = 'CTRL' OR gene2 = 'CTRL' THEN 'Single'
            ELSE 'Dual' END AS arity, {_fc_sql(source)} FROM {source}""",
    )
    cte(
        f"{q}fc",
        f"SELECT {IDS}, arity, "
        + ", ".join(f"""("{c}" - (SELECT median("{c}") FROM {q}raw WHERE arity = 'Control')) / 6.3 AS "{c}\"""" for c in LINES)
        + f" FROM {q}raw",
    )
    cte(
        f"{q}mean",
        f"""SELECT {IDS}, arity, CASE WHEN gene1 > gene2 THEN guide2 || '|' || guide1 ELSE guide1 || '|' || guide2 END AS guide_pair,
            "F", "O" FROM {q}fc""",
    )
    cte(
        f"{q}abba",
        f"""SELECT m.*, a."F_abba", a."O_abba" FROM {q}mean m JOIN (SELECT guide_pair, avg("F") AS "F_abba", avg("O") AS "O_abba"
           FROM {q}mean GROUP BY guide_pair) a USING (guide_pair)""",
    )
    cte(
        f"{q}long",
        f"""SELECT {IDS}, arity, 'F' AS sample, "F_abba" AS fc FROM {q}abba WHERE "F_abba" IS NOT NULL UNION ALL SELECT {IDS}, arity, 'O', "O_abba" FROM {q}abba WHERE "O_abba" IS NOT NULL""",
    )
    cte(
        f"{q}pheno",
        f"""SELECT sample, guide1 AS guide, avg(fc) AS phenotype, 1 AS position FROM {q}long WHERE arity <> 'Dual' AND gene2 = 'CTRL' GROUP BY ALL
           UNION ALL SELECT sample, guide2, avg(fc), 2 FROM {q}long WHERE arity <> 'Dual' AND gene1 = 'CTRL' GROUP BY ALL""",
    )
    cte(
        f"{q}rows",
        f"""SELECT l.*, coalesce(a.phenotype, 0) AS pheno1, coalesce(b.phenotype, 0) AS pheno2 FROM {q}long l
           LEFT JOIN {q}pheno a ON a.position = 1 AND l.sample = a.sample AND l.guide1 = a.guide
           LEFT JOIN {q}pheno b ON b.position = 2 AND l.sample = b.sample AND l.guide2 = b.guide""",
    )
    cte(f"{q}fit_a", _quad_sql(f"{q}rows", "guide2", "pheno1", "pheno2"))
    cte(f"{q}fit_b", _quad_sql(f"{q}rows", "guide1", "pheno2", "pheno1"))
    cte(
        f"{q}res",
        f"""SELECT r.*, fc - (a.m0 * pheno1 ** 2 + a.m1 * pheno1 + pheno2) AS ra, fc - (b.m0 * pheno2 ** 2 + b.m1 * pheno2 + pheno1) AS rb
           FROM {q}rows r JOIN {q}fit_a a ON r.sample = a.sample AND r.guide2 = a.guide JOIN {q}fit_b b ON r.sample = b.sample AND r.guide1 = b.guide""",
    )
    cte(
        f"{q}norm",
        f"""SELECT *, trunc(ra / coalesce(nullif(stddev_pop(CASE WHEN gene1 = 'CTRL' THEN ra END) OVER (PARTITION BY sample, guide2), 0), 1)) AS score_a,
             rb / coalesce(nullif(stddev_pop(CASE WHEN gene2 = 'CTRL' THEN rb END) OVER (PARTITION BY sample, guide1), 0), 1) AS score_b FROM {q}res""",
    )
    cte(
        f"{q}gi",
        f"""SELECT n.*, (n.score_a + n.score_b + coalesce(m.score_a + m.score_b, 0)) / 4 AS gi FROM {q}norm n
           LEFT JOIN {q}norm m ON n.sample = m.sample AND n.guide1 = m.guide2 AND n.guide2 = m.guide1""",
    )
    cte(
        f"{q}pairs",
        f"""SELECT sample, least(gene1, gene2) || '|' || greatest(gene1, gene2) AS gene_pair, avg(gi) AS sl_score,
             stddev_samp(gi) / sqrt(count(gi)) AS standard_error FROM {q}gi
           WHERE gene1 <> 'CTRL' AND gene2 <> 'CTRL' GROUP BY 1, 2""",
    )


cte(
    "averaged_screen",
    f"SELECT {IDS}, t0, " + ", ".join(f"""({' + '.join(f'coalesce({c}, 0)' for c in LAYOUT.samples[s])}) / 3 AS "{s}\"""" for s in LINES) + " FROM screen",
)
_low = " UNION ".join(
    f"""SELECT '{s}' AS sample, guide{i} AS guide FROM averaged_screen GROUP BY guide{i} HAVING median("{s}") < 44""" for s in LINES for i in (1, 2)
)
cte("low_averaged", _low)
cte(
    "masked_averaged",
    f"SELECT {IDS}, t0, "
    + ", ".join(
        f"""CASE WHEN guide1 NOT IN (SELECT guide FROM low_averaged WHERE sample = '{s}')
            AND guide2 NOT IN (SELECT guide FROM low_averaged WHERE sample = '{s}') THEN "{s}" END AS "{s}\""""
        for s in LINES
    )
    + " FROM averaged_screen",
)
_quadratic_ctes("q", "averaged_screen")
_quadratic_ctes("h", "masked_averaged")


def _pheno(spark, d):
    return stage(quad.construct_phenotypes(_stored(spark, d), LAYOUT, threshold=0), "phenotypes")


def _fitness(spark, d):
    from duoscreen.functions.labels import same_gene_is_dual, target_arity

    df, layout = quad.one_change(_stored(spark, d), LAYOUT)
    df = df.withColumn("arity", same_gene_is_dual(target_arity(CONTROL)))
    df = normalize.fitness_fold_change(df, layout, F.col("arity") == "Control")
    return df.select(*CONSTRUCT, "arity", *[F.col(cols[0]).alias(s) for s, cols in layout.samples.items()])


@query("fitness_fc", f"""SELECT {IDS}, arity, "F", "O" FROM qfc""", LINES)
def fitness_fc(spark, d):
    return _fitness(spark, d)


PAIRED = Layout(samples={"O": LAYOUT.samples["O"]}, t0={"O": LAYOUT.samples["F"]}, control=CONTROL)
MANY = Layout(samples={"O": LAYOUT.samples["O"]}, t0={"O": LAYOUT.samples["F"]}, control=CONTROL, pairing="averaged")
_PAIRS = list(zip(LAYOUT.samples["O"], LAYOUT.samples["F"]))
cte(
    "pairedraw",
    f"SELECT {IDS}, gene1 = 'CTRL' AND gene2 = 'CTRL' AS control, "
    + ", ".join(f"log2(({c} + 10) / ({e} + 10) / (SELECT sum({e} + 10) / sum({c} + 10) FROM screen)) AS {c}" for c, e in _PAIRS)
    + " FROM screen",
)


@query(
    "fitness_fc_paired",
    f"SELECT {IDS}, " + ", ".join(f"({c} - (SELECT median({c}) FROM pairedraw WHERE control)) / 6.3 AS {c}" for c, _ in _PAIRS) + " FROM pairedraw",
    [c for c, _ in _PAIRS],
)
def fitness_fc_paired(spark, d):
    control = (F.col("gene1") == CONTROL) & (F.col("gene2") == CONTROL)
    return normalize.fitness_fold_change(_stored(spark, d), PAIRED, control).select(*CONSTRUCT, *PAIRED.late)


@query(
    "natural_log_lfc_paired",
    f"SELECT {IDS}, " + ", ".join(f"CASE WHEN {c} > 0 AND {e} > 0 THEN ln({c} / {e}) END AS {c}" for c, e in _PAIRS) + " FROM screen",
    [c for c, _ in _PAIRS],
)
def natural_log_lfc_paired(spark, d):
    return normalize.fold_changes(_screen(spark, d), PAIRED, None).select(*CONSTRUCT, *PAIRED.late)


@query(
    "rpm_mask_paired",
    f"SELECT {IDS}, "
    + ", ".join(f"CASE WHEN NOT ({e} * 1e6 / (SELECT sum({e}) FROM screen) < 150) THEN {x} END AS {x}" for c, e in _PAIRS for x in (c, e))
    + " FROM screen",
    [x for p in _PAIRS for x in p],
)
def rpm_mask_paired(spark, d):
    df = filters.mask_low_pool(_screen(spark, d), PAIRED, 150.0)
    return df.select(*CONSTRUCT, *PAIRED.late, *PAIRED.early)


def _many_sql(one: str) -> str:
    """Each late column minus the mean over the early ones; ``one`` is the value of column {c}."""
    early = " + ".join(one.format(c=e) for _, e in _PAIRS)
    return f"SELECT {IDS}, " + ", ".join(f"{one.format(c=c)} - ({early}) / 3 AS {c}" for c, _ in _PAIRS) + " FROM screen"


@query("depth_lfc_many_early", _many_sql("log2({c} / (SELECT sum({c}) FROM screen) * 1e6 + 1)"), MANY.late)
def depth_lfc_many_early(spark, d):
    return normalize.depth_normalised_fold_change(_screen(spark, d), MANY).select(*CONSTRUCT, *MANY.late)


@query("median_lfc_many_early", _many_sql("(log2({c} + 32) - (SELECT median(log2({c} + 32)) FROM screen))"), MANY.late)
def median_lfc_many_early(spark, d):
    return normalize.median_normalised_fold_change(_stored(spark, d), MANY).select(*CONSTRUCT, *MANY.late)


@query("abba_average", """SELECT guide1, guide2, guide_pair, "F", "O", "F_abba", "O_abba" FROM qabba""", ["F", "O", "F_abba", "O_abba"])
def abba_average(spark, d):
    df = normalize.orientation_average(stage(_fitness(spark, d), "fitness"), LINES)
    return df.select("guide1", "guide2", "guide_pair", "F", "O", "F_abba", "O_abba")


@query("guide_phenotypes", "SELECT * FROM qpheno", ["phenotype"])
def guide_phenotypes(spark, d):
    return quad.guide_phenotypes(_pheno(spark, d), CONTROL)


@query("quad_fit", "SELECT sample, guide AS guide2, m0, m1 FROM qfit_a", ["m0", "m1"])
def quad_fit(spark, d):
    long = _pheno(spark, d)
    rows = quad.attach_phenotypes(long, quad.guide_phenotypes(long, CONTROL))
    return stats.quadratic_fit(rows, ["sample", "guide2"], F.col("pheno1"), F.col("fc"), F.col("pheno2"))


@query(
    "quadratic_constructs",
    "SELECT sample, guide1, guide2, score_a, score_b, gi FROM qgi",
    ["score_a", "score_b", "gi"],
)
def quadratic_constructs(spark, d):
    df = quad.construct_gi(_pheno(spark, d), CONTROL)
    return df.select("sample", "guide1", "guide2", "score_a", "score_b", "gi")


@query("quadratic_pairs", "SELECT * FROM qpairs", ["sl_score", "standard_error"])
def quadratic_pairs(spark, d):
    return quad.quadratic_gi(_stored(spark, d), LAYOUT, threshold=0)


@query("quadratic_pairs_filtered", "SELECT * FROM hpairs", ["sl_score", "standard_error"])
def quadratic_pairs_filtered(spark, d):
    return quad.quadratic_gi(_stored(spark, d), LAYOUT, threshold=44)


@query(
    "matrix_lookup",
    """SELECT a.sample, a.guide1, a.guide2, (a.score_b + coalesce(b.score_b, 0)) / 2 AS score_b FROM qnorm a
       LEFT JOIN qnorm b ON a.sample = b.sample AND a.guide1 = b.guide2 AND a.guide2 = b.guide1""",
    ["score_b"],
)
def matrix_lookup(spark, d):
    long = _pheno(spark, d)
    rows = stage(quad.attach_phenotypes(long, quad.guide_phenotypes(long, CONTROL)), "guide-phenotypes")
    scored = quad.in_control_units(stage(quad.query_residuals(rows), "residuals"), CONTROL)
    one = stage(scored.select("sample", "guide1", "guide2", "score_b"), "scored")
    return reshape.matrix_lookup(one.drop("score_b"), one, "guide1", "guide2", "score_b", ["sample"])
