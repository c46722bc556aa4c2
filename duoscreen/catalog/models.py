"""Queries of the moderated-t and the variational score."""

from __future__ import annotations

from pyspark.sql import functions as F

from duoscreen.catalog.base import cte, query
from duoscreen.catalog.screens import CONTROL, COUNTS, IDS, _screen, _stored
from duoscreen.catalog.scores import p_sql
from duoscreen.functions.labels import pair_key
from duoscreen.operators import normalize, stats
from duoscreen.plans import moderated_gi as mod, variational_gi as var
from duoscreen.screen import CONSTRUCT
from duoscreen.session import stage
from duoscreen.sources.lineitem_screen import ESSENTIALS, LAYOUT

LATE = LAYOUT.late
SWEEPS, LOOSE = 20, 0.2  # where the tables of sweeps end


# moderated t

cte(
    "mnorm",
    f"SELECT {IDS}, " + ", ".join(f"log2({c} / (SELECT sum({c}) FROM screen) * 1e6 + 1) - n0 AS {c}" for c in LATE)
    + " FROM (SELECT *, log2(t0 / (SELECT sum(t0) FROM screen) * 1e6 + 1) AS n0 FROM screen)",
)
cte(
    "mlfc",
    " UNION ALL ".join(
        f"SELECT {IDS}, '{s}' AS sample, ({' + '.join(c)}) / {len(c)} AS lfc FROM mnorm" for s, c in LAYOUT.samples.items()
    ),
)
cte(
    "mside",
    """SELECT sample, gene, avg(lfc) FILTER (pos = 1) AS p1, avg(lfc) FILTER (pos = 2) AS p2 FROM (
         SELECT sample, gene1 AS gene, 1 AS pos, lfc FROM mlfc WHERE gene2 = 'CTRL' AND gene1 <> 'CTRL' UNION ALL
         SELECT sample, gene2, 2, lfc FROM mlfc WHERE gene1 = 'CTRL' AND gene2 <> 'CTRL') GROUP BY ALL""",
)
cte(
    "mres",
    """SELECT l.sample, guide1, guide2, least(l.gene1, l.gene2) || '_' || greatest(l.gene1, l.gene2) AS gene_pair, lfc,
         coalesce(a.p1, a.p2) + coalesce(b.p2, b.p1) AS expected, lfc - (coalesce(a.p1, a.p2) + coalesce(b.p2, b.p1)) AS residual FROM mlfc l
       JOIN mside a ON l.sample = a.sample AND l.gene1 = a.gene JOIN mside b ON l.sample = b.sample AND l.gene2 = b.gene
       WHERE l.gene1 <> 'CTRL' AND l.gene2 <> 'CTRL' AND l.gene1 <> l.gene2""",
)
cte(
    "wlfc",
    " UNION ALL ".join(
        f"SELECT {IDS}, '{s}' AS sample, ({' + '.join(c)}) / {len(c)} AS lfc FROM mnorm JOIN (SELECT guide1, guide2 FROM screen "
        f"WHERE t0 >= 80 AND t0 <= 400) USING (guide1, guide2)"
        for s, c in LAYOUT.samples.items()
    ),
)
cte(
    "wside",
    """SELECT sample, gene, avg(lfc) FILTER (pos = 1) AS p1, avg(lfc) FILTER (pos = 2) AS p2 FROM (
         SELECT sample, gene1 AS gene, 1 AS pos, lfc FROM wlfc WHERE gene2 = 'CTRL' AND gene1 <> 'CTRL' UNION ALL
         SELECT sample, gene2, 2, lfc FROM wlfc WHERE gene1 = 'CTRL' AND gene2 <> 'CTRL') GROUP BY ALL""",
)
cte(
    "wres",
    """SELECT l.sample, least(l.gene1, l.gene2) || '_' || greatest(l.gene1, l.gene2) AS gene_pair, lfc,
         lfc - (coalesce(a.p1, a.p2) + coalesce(b.p2, b.p1)) AS residual FROM wlfc l
       JOIN wside a ON l.sample = a.sample AND l.gene1 = a.gene JOIN wside b ON l.sample = b.sample AND l.gene2 = b.gene
       WHERE l.gene1 <> 'CTRL' AND l.gene2 <> 'CTRL' AND l.gene1 <> l.gene2""",
)
cte(
    "mmom",
    """SELECT sample, gene_pair, count(*) AS n, avg(lfc) AS mean_observed, avg(expected) AS mean_expected, avg(residual) AS effect,
         var_samp(residual) AS variance FROM mres GROUP BY sample, gene_pair""",
)


def _series(x: str, power: int) -> str:
    """Sum of 1 / (x + k)^power for k = 0..19."""
    return f"list_sum(list_transform(range(0, 20), lambda k: 1.0 / pow({x} + k, {power})))"


def digamma_sql(x: str) -> str:
    z = f"({x} + 20)"
    return f"(ln({z}) - 0.5 / {z} - 1 / (12 * pow({z}, 2)) + 1 / (120 * pow({z}, 4)) - 1 / (252 * pow({z}, 6)) - {_series(x, 1)})"


def trigamma_sql(x: str) -> str:
    z = f"({x} + 20)"
    return (
        f"(1 / {z} + 1 / (2 * pow({z}, 2)) + 1 / (6 * pow({z}, 3)) - 1 / (30 * pow({z}, 5)) + 1 / (42 * pow({z}, 7))"
        f" + {_series(x, 2)})"
    )


def tetragamma_sql(x: str) -> str:
    z = f"({x} + 20)"
    return (
        f"(-1 / pow({z}, 2) - 1 / pow({z}, 3) - 1 / (2 * pow({z}, 4)) + 1 / (6 * pow({z}, 6)) - 1 / (6 * pow({z}, 8))"
        f" - 2 * {_series(x, 3)})"
    )


_newton = f"list_reduce(list_prepend(0.5 + 1 / excess, list_transform(range(0, 30), lambda i: 0.0::DOUBLE)), lambda x, y: x + {trigamma_sql('x')} * (1 - {trigamma_sql('x')} / excess) / {tetragamma_sql('x')})"
cte(
    "mprior",
    f"""SELECT sample, d0, CASE WHEN d0 IS NULL THEN exp(m) ELSE exp(m + {digamma_sql('d0 / 2')} - ln(d0 / 2)) END AS s02, pooled FROM (
          SELECT sample, m, pooled, CASE WHEN excess > 0 THEN 2 * {_newton} END AS d0 FROM (
            SELECT sample, avg(e) AS m, var_samp(e) - avg(tri) AS excess, sum(dof) AS pooled FROM (
              SELECT sample, ln(variance) - {digamma_sql('dof / 2')} + ln(dof / 2) AS e, {trigamma_sql('dof / 2')} AS tri, dof
              FROM (SELECT *, (n - 1)::DOUBLE AS dof FROM mmom WHERE variance > 0 AND n > 1)) GROUP BY sample))""",
)
cte(
    "mtest",
    f"""SELECT *, {p_sql('t', 'df')} AS p_val FROM (
          SELECT sample, gene_pair, n, mean_observed, mean_expected, effect, variance, d0, s02, effect / sqrt(post / n) AS t, df FROM (
            SELECT m.*, d0, s02, CASE WHEN d0 IS NULL THEN s02 ELSE (d0 * s02 + (n - 1) * variance) / (d0 + n - 1) END AS post,
              CASE WHEN d0 IS NULL THEN pooled ELSE least(d0 + n - 1, pooled) END AS df FROM mmom m JOIN mprior USING (sample)))""",
)
cte(
    "mfdr",
    """SELECT *, CASE WHEN fdr < 0.2 AND abs(effect) > 0.5 THEN CASE WHEN effect < 0 THEN 'Sensitizer' ELSE 'Suppressor' END ELSE 'None' END AS call
       FROM (SELECT *, least(1.0, min(q) OVER (PARTITION BY sample ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM (
         SELECT *, p_val * count(*) OVER (PARTITION BY sample) / rn AS q FROM (
           SELECT *, row_number() OVER (PARTITION BY sample ORDER BY p_val) AS rn FROM mtest)))""",
)


def _mlong(spark, d):
    return stage(mod.screen_fold_changes(_screen(spark, d), LAYOUT), "fold-changes")


@query("depth_lfc", f"SELECT {IDS}, {', '.join(LATE)} FROM mnorm", LATE)
def depth_lfc(spark, d):
    return normalize.depth_normalised_fold_change(_screen(spark, d), LAYOUT).select(*CONSTRUCT, *LATE)


@query(
    "pair_residuals",
    "SELECT sample, guide1, guide2, gene_pair, lfc, expected, residual FROM mres",
    ["lfc", "expected", "residual"],
)
def pair_residuals(spark, d):
    df = mod.pair_residuals(_mlong(spark, d), CONTROL)
    return df.select("sample", "guide1", "guide2", "gene_pair", "lfc", "expected", "residual")


@query("variance_prior", "SELECT sample, d0, s02 FROM mprior", ["d0", "s02"])
def variance_prior(spark, d):
    residuals = mod.pair_residuals(_mlong(spark, d), CONTROL)
    moments = residuals.groupBy("sample", "gene_pair").agg(
        F.var_samp("residual").alias("variance"), (F.count("residual") - 1).cast("double").alias("dof")
    )
    return stats.moderated_variance(stage(moments, "pair-moments"), "sample", "variance", "dof")


_M = ["mean_observed", "mean_expected", "effect", "t", "df", "p_val", "fdr"]


@query("moderated_pairs", f"SELECT sample, gene_pair, n, {', '.join(_M)}, call FROM mfdr", _M)
def moderated_pairs(spark, d):
    df = mod.moderated_gi(_screen(spark, d), LAYOUT, [CONTROL])
    return df.select("sample", "gene_pair", "n", *_M, "call")


@query(
    "moderated_pairs_window",
    """SELECT sample, gene_pair, count(*) AS n, avg(lfc) AS mean_observed, avg(residual) AS effect FROM wres GROUP BY ALL""",
    ["mean_observed", "effect"],
)
def moderated_pairs_window(spark, d):
    df = mod.moderated_gi(_screen(spark, d), LAYOUT, [CONTROL], min_reads=80.0, max_reads=400.0)
    return df.select("sample", "gene_pair", "n", "mean_observed", "effect")


@query(
    "moderated_audit",
    f"""SELECT {IDS}, l.sample, lfc FROM (
          SELECT {IDS}, sample, lfc FROM mlfc UNION ALL
          SELECT gene2, gene1, guide2, guide1, sample, lfc FROM mlfc WHERE gene1 <> 'CTRL' AND gene2 <> 'CTRL') l
        LEFT JOIN mside a ON l.sample = a.sample AND l.gene1 = a.gene LEFT JOIN mside b ON l.sample = b.sample AND l.gene2 = b.gene
        WHERE l.gene1 <> 'CTRL' AND l.gene2 <> 'CTRL' AND l.gene1 <> l.gene2 AND (a.p1 IS NULL OR b.p2 IS NULL)""",
    ["lfc"],
)
def moderated_audit(spark, d):
    """Doubles that lack a single effect at their own position; genes 10 and 11 never stand at position 2."""
    long = _mlong(spark, d)
    swap = {"gene1": "gene2", "gene2": "gene1", "guide1": "guide2", "guide2": "guide1"}
    doubles = long.where((F.col("gene1") != CONTROL) & (F.col("gene2") != CONTROL))
    both = stage(long.unionByName(doubles.select(*[F.col(swap.get(c, c)).alias(c) for c in doubles.columns])), "both")
    lost = mod.unscored_constructs(both, CONTROL, ignore_orientation=False)
    return lost.select(*CONSTRUCT, "sample", "lfc")


@query(
    "moderated_hits",
    """SELECT sample, gene_pair, effect, fdr, CASE WHEN fdr < 0.9 AND abs(effect) > 0.05 THEN
         CASE WHEN effect < 0 THEN 'Sensitizer' ELSE 'Suppressor' END ELSE 'None' END AS call FROM mfdr""",
    ["effect", "fdr"],
)
def moderated_hits(spark, d):
    scored = mod.score_pairs(mod.pair_residuals(_mlong(spark, d), CONTROL))
    return mod.call_hits(scored, fdr=0.9, effect=0.05).select("sample", "gene_pair", "effect", "fdr", "call")


@query(
    "ordered_pair_effects",
    """SELECT sample, substr(guide1, 1, 3) || '_' || substr(guide2, 1, 3) AS gene_pair, count(*) AS n, avg(residual) AS effect
       FROM mres GROUP BY ALL""",
    ["effect"],
)
def ordered_pair_effects(spark, d):
    df = mod.pair_residuals(_mlong(spark, d), CONTROL, ignore_orientation=False)
    return df.groupBy("sample", "gene_pair").agg(F.count("residual").alias("n"), F.avg("residual").alias("effect"))


cte(
    "mguide",
    """SELECT sample, gene, guide, avg(lfc) FILTER (pos = 1) AS p1, avg(lfc) FILTER (pos = 2) AS p2 FROM (
         SELECT sample, gene1 AS gene, guide1 AS guide, 1 AS pos, lfc FROM mlfc WHERE gene2 = 'CTRL' AND gene1 <> 'CTRL' UNION ALL
         SELECT sample, gene2, guide2, 2, lfc FROM mlfc WHERE gene1 = 'CTRL' AND gene2 <> 'CTRL') GROUP BY ALL""",
)
cte(
    "mboth",
    """SELECT l.sample, least(l.gene1, l.gene2) || '_' || greatest(l.gene1, l.gene2) AS gene_pair, lfc,
         coalesce(a.p1, a.p2) + coalesce(b.p2, b.p1) AS expected FROM mlfc l
       JOIN mguide a ON l.sample = a.sample AND l.gene1 = a.gene AND l.guide1 = a.guide
       JOIN mguide b ON l.sample = b.sample AND l.gene2 = b.gene AND l.guide2 = b.guide
       WHERE l.gene1 <> 'CTRL' AND l.gene2 <> 'CTRL' AND l.gene1 <> l.gene2""",
)
cte(
    "mranks",
    """SELECT sample, gene_pair, first, rank() OVER p + (count(*) OVER same - 1) / 2.0 AS midrank, count(*) OVER same AS tied
       FROM (SELECT sample, gene_pair, TRUE AS first, lfc AS v FROM mboth UNION ALL SELECT sample, gene_pair, FALSE, expected FROM mboth)
       WINDOW p AS (PARTITION BY sample, gene_pair ORDER BY v), same AS (PARTITION BY sample, gene_pair, v)""",
)
cte(
    "mu",
    """SELECT sample, gene_pair, n::DOUBLE AS n, u, (u - n * n / 2.0 - sign(u - n * n / 2.0) * 0.5)
         / sqrt(n * n / 12.0 * (2 * n + 1 - ties / (2.0 * n * (2 * n - 1)))) AS z FROM (
       SELECT sample, gene_pair, count(*) FILTER (first) AS n, sum(midrank) FILTER (first) - count(*) FILTER (first) * (count(*) FILTER (first) + 1) / 2.0 AS u,
         sum(tied * tied - 1)::DOUBLE AS ties FROM mranks GROUP BY ALL)""",
)
_normal = "least(1.0, 1 - 2 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END) * exp(-pow(abs(z) * i / 2000, 2) / 2))) * abs(z) / 2000 / 3 / sqrt(2 * pi()))"
cte(
    "mrfdr",
    f"""SELECT *, least(1.0, min(q) OVER (PARTITION BY sample ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM (
         SELECT *, p_val * count(*) OVER (PARTITION BY sample) / rn AS q FROM (
           SELECT *, row_number() OVER (PARTITION BY sample ORDER BY p_val, gene_pair) AS rn FROM (SELECT *, {_normal} AS p_val FROM mu)))""",
)


@query(
    "rank_sum_pairs",
    """SELECT sample, gene_pair, m.n::BIGINT AS n, mean_observed, mean_expected, effect, u, z, p_val, fdr,
         CASE WHEN fdr < 0.2 AND abs(effect) > 0.5 THEN CASE WHEN effect < 0 THEN 'Sensitizer' ELSE 'Suppressor' END ELSE 'None' END AS call
       FROM mrfdr JOIN (SELECT sample, gene_pair, count(*) AS n, avg(lfc) AS mean_observed, avg(expected) AS mean_expected,
         avg(lfc - expected) AS effect FROM mboth GROUP BY ALL) m USING (sample, gene_pair)""",
    ["mean_observed", "mean_expected", "effect", "u", "z", "p_val", "fdr"],
)
def rank_sum_pairs(spark, d):
    return mod.moderated_gi(_screen(spark, d), LAYOUT, [CONTROL], test="rank-sum")


# local regression, written out as weighted sums of all rows at each knot

KNOTS, REACH = 41, 12
cte(
    "mknot",
    f"""SELECT sample, k, (low + k * step) AS place, step FROM (SELECT sample, min(expected) AS low, (max(expected) - min(expected)) / {KNOTS - 1} AS step
         FROM mres GROUP BY sample), range(0, {KNOTS}) t(k)""",
)
cte(
    "mline",
    f"""SELECT sample, k, CASE WHEN s2 / s0 - (s1 / s0) ** 2 > 1e-9 THEN t0 / s0 - s1 / s0 * (t1 / s0 - s1 / s0 * t0 / s0) / (s2 / s0 - (s1 / s0) ** 2)
         ELSE t0 / s0 END AS f FROM (
         SELECT sample, k, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * residual) AS t0, sum(w * u * residual) AS t1 FROM (
           SELECT *, pow(1 - pow(abs(u), 3), 3) AS w FROM (
             SELECT r.sample, k, residual, (expected - place) / ({REACH} * step) AS u FROM mres r JOIN mknot USING (sample)) WHERE abs(u) < 1) GROUP BY ALL)""",
)
cte(
    "mtrend",
    f"""SELECT r.*, a.f * (1 - v) + CASE WHEN v = 0 THEN 0 ELSE b.f * v END AS trend FROM (
         SELECT *, t - j AS v FROM (SELECT *, least(floor(t), {KNOTS - 2})::INT AS j FROM (
           SELECT r.*, (expected - k.place) / step AS t FROM mres r JOIN mknot k ON r.sample = k.sample AND k.k = 0))) r
       JOIN mline a ON r.sample = a.sample AND a.k = j LEFT JOIN mline b ON r.sample = b.sample AND b.k = j + 1""",
)


@query(
    "loess_residuals",
    "SELECT sample, guide1, guide2, gene_pair, expected, trend, residual - trend AS residual FROM mtrend",
    ["expected", "trend", "residual"],
)
def loess_residuals(spark, d):
    residuals = stage(mod.pair_residuals(_mlong(spark, d), CONTROL), "residuals")
    return mod.without_trend(residuals, KNOTS, REACH).select("sample", "guide1", "guide2", "gene_pair", "expected", "trend", "residual")


@query(
    "moderated_pairs_loess",
    """SELECT sample, gene_pair, count(*) AS n, avg(lfc) AS mean_observed, avg(residual - trend) AS effect, var_samp(residual - trend) AS variance
       FROM mtrend GROUP BY ALL""",
    ["mean_observed", "effect", "variance"],
)
def moderated_pairs_loess(spark, d):
    df = mod.moderated_gi(_screen(spark, d), LAYOUT, [CONTROL], loess=True)
    return df.select("sample", "gene_pair", "n", "mean_observed", "effect", "variance")


# variational model, its first sweeps written out

cte(
    "glog",
    f"SELECT {IDS}, " + ", ".join(f"log2({c} + 32) AS {c}" for c in COUNTS) + " FROM screen",
)
cte(
    "gnorm",
    f"SELECT {IDS}, "
    + ", ".join(f"({c} - (SELECT median({c}) FROM glog)) - (t0 - (SELECT median(t0) FROM glog)) AS {c}" for c in LATE)
    + " FROM glog",
)
cte(
    "glfc",
    " UNION ALL ".join(
        f"SELECT {IDS}, '{s}' AS sample, ({' + '.join(c)}) / {len(c)} AS d, list_var_samp([{', '.join(c)}]) / {len(c)} AS noise FROM gnorm"
        for s, c in LAYOUT.samples.items()
    ),
)
cte(
    "gr_0",
    """SELECT *, 0.5 / rate AS tau FROM (SELECT *, 0.5 * avg(noise) OVER (PARTITION BY sample) AS rate, 1.0::DOUBLE AS xx, 1.0::DOUBLE AS xx2,
         CASE WHEN gene1 <> 'CTRL' AND gene2 <> 'CTRL' THEN least(gene1, gene2) || '_' || greatest(gene1, gene2) END AS pair
       FROM glfc WHERE gene1 <> gene2)""",
)
cte(
    "gy_0",
    """SELECT gene, sample, y, y * y AS y2 FROM (SELECT CASE WHEN gene1 = 'CTRL' THEN gene2 ELSE gene1 END AS gene, sample, median(d) AS y
       FROM gr_0 WHERE pair IS NULL GROUP BY ALL)""",
)
cte(
    "gs_0",
    """SELECT pair, sample, s, s * s AS s2 FROM (SELECT pair, r.sample, median(d - a.y - b.y) AS s FROM gr_0 r
       JOIN gy_0 a ON gene1 = a.gene AND r.sample = a.sample JOIN gy_0 b ON gene2 = b.gene AND r.sample = b.sample
       WHERE pair IS NOT NULL GROUP BY ALL)""",
)
cte("ga_0", "SELECT DISTINCT guide1 AS guide, 1.0::DOUBLE AS x, 1.0::DOUBLE AS x2 FROM gr_0 WHERE gene1 <> 'CTRL'")
cte("gb_0", "SELECT DISTINCT guide2 AS guide, 1.0::DOUBLE AS x, 1.0::DOUBLE AS x2 FROM gr_0 WHERE gene2 <> 'CTRL'")


def _at(a: int, b: int, y: int, s: int, r: int) -> str:
    """Rows joined with the given generation of each parameter."""
    return f"""(SELECT r.*, coalesce(a.x, 0) AS a, coalesce(a.x2, 0) AS a2, coalesce(b.x, 0) AS b, coalesce(b.x2, 0) AS b2,
      coalesce(u.y, 0) AS ya, coalesce(u.y2, 0) AS ya2, coalesce(v.y, 0) AS yb, coalesce(v.y2, 0) AS yb2, coalesce(w.s, 0) AS s,
      coalesce(w.s2, 0) AS s2 FROM gr_{r} r LEFT JOIN ga_{a} a ON guide1 = a.guide LEFT JOIN gb_{b} b ON guide2 = b.guide
      LEFT JOIN gy_{y} u ON gene1 = u.gene AND r.sample = u.sample LEFT JOIN gy_{y} v ON gene2 = v.gene AND r.sample = v.sample
      LEFT JOIN gs_{s} w ON r.pair = w.pair AND r.sample = w.sample)"""


for _k in range(SWEEPS):
    n = _k + 1
    _x = "SELECT guide, m AS x, m * m + 1 / p AS x2 FROM (SELECT {g} AS guide, 1 + sum(tau * {w}2) AS p, (1 + sum(tau * {w} * (d - {o} - xx * s))) / (1 + sum(tau * {w}2)) AS m FROM {t} WHERE {gene} <> 'CTRL' GROUP BY {g})"
    cte(f"ga_{n}", _x.format(g="guide1", w="ya", o="b * yb", gene="gene1", t=_at(_k, _k, _k, _k, _k)))
    cte(f"gb_{n}", _x.format(g="guide2", w="yb", o="a * ya", gene="gene2", t=_at(n, _k, _k, _k, _k)))
    cte(f"gt_{n}", f"SELECT * FROM {_at(n, n, _k, _k, _k)}")
    cte(
        f"gy_{n}",
        f"""SELECT gene, sample, m AS y, m * m + 1 / p AS y2 FROM (
              SELECT gene, sample, 0.01 + sum(w) AS p, sum(r) / (0.01 + sum(w)) AS m FROM (
                SELECT gene1 AS gene, sample, tau * a2 AS w, tau * a * (d - b * yb - xx * s) AS r FROM gt_{n} UNION ALL
                SELECT gene2, sample, tau * b2, tau * b * (d - a * ya - xx * s) FROM gt_{n}) WHERE gene <> 'CTRL' GROUP BY ALL)""",
    )
    cte(
        f"gs_{n}",
        f"""SELECT pair, sample, m AS s, m * m + 1 / p AS s2 FROM (
              SELECT pair, sample, 0.01 + sum(tau * xx2) AS p, sum(tau * xx * (d - a * ya - b * yb)) / (0.01 + sum(tau * xx2)) AS m
              FROM {_at(n, n, n, _k, _k)} WHERE pair IS NOT NULL GROUP BY ALL)""",
    )
    cte(
        f"ge_{n}",
        f"""SELECT *, d - a * ya - b * yb - nx * s AS err, a2 * ya2 - (a * ya) ** 2 + b2 * yb2 - (b * yb) ** 2 + nx2 * s2 - (nx * s) ** 2 AS spread
            FROM (SELECT *, nx * nx + 1 / p AS nx2 FROM (
              SELECT *, m / p AS nx FROM (SELECT *, 1 + sum(tau * s2) OVER (PARTITION BY {IDS}) AS p,
                1 + sum(tau * s * (d - a * ya - b * yb)) OVER (PARTITION BY {IDS}) AS m FROM {_at(n, n, n, n, _k)})))""",
    )
    cte(f"gr_{n}", f"SELECT {IDS}, sample, d, rate, 1 / (rate + 0.5 * (err * err + spread)) AS tau, nx AS xx, nx2 AS xx2, pair FROM ge_{n}")

def _cost(table: str, value: str, mean: int, sd: int) -> str:
    return f"""SELECT -(-0.5 * ln({value}2 - {value} ** 2) + ({value}2 - {value} ** 2 + ({value} - {mean}) ** 2) / (2.0 * {sd} ** 2)) AS part FROM {table}"""


for _k in range(1, SWEEPS + 1):
    _xx = f"(SELECT max(xx) AS xx, max(xx2) AS xx2 FROM gr_{_k} WHERE pair IS NOT NULL GROUP BY {IDS})"
    _parts = [_cost(_xx, "xx", 1, 1), *[_cost(f"g{t}_{_k}", v, m, s) for t, v, m, s in (("a", "x", 1, 1), ("b", "x", 1, 1), ("y", "y", 0, 10), ("s", "s", 0, 10))]]
    cte(f"gbound_{_k}", f"SELECT sum(part) AS bound FROM (SELECT ln(tau) AS part FROM gr_{_k} UNION ALL {' UNION ALL '.join(_parts)})")

_SWEEPS = range(1, SWEEPS + 1)
cte("gbounds", " UNION ALL ".join(f"SELECT {k}::INT AS sweep, bound FROM gbound_{k}" for k in _SWEEPS))
for _k in _SWEEPS:
    cte(
        f"gchange_{_k}",
        f"""SELECT {_k}::INT AS sweep, sample, max(abs(v - w)) / max(abs(v)) AS change FROM (
              SELECT n.sample, n.y AS v, o.y AS w FROM gy_{_k} n JOIN gy_{_k - 1} o ON n.gene = o.gene AND n.sample = o.sample UNION ALL
              SELECT n.sample, n.s, o.s FROM gs_{_k} n JOIN gs_{_k - 1} o ON n.pair = o.pair AND n.sample = o.sample) GROUP BY sample""",
    )
cte("gchanges", " UNION ALL ".join(f"SELECT * FROM gchange_{k}" for k in _SWEEPS))
cte(
    "gstop",
    f"""SELECT coalesce(min(sweep), {SWEEPS}) AS stop FROM (SELECT sweep, max(change) AS change FROM gchanges GROUP BY sweep)
        WHERE change <= {LOOSE}""",
)


# the fit until it has settled: one table of rows, which carry the moments of all their parameters from sweep to sweep

TOLERANCE = 1e-3


def _mean(table: str, keys: str, keep: str, names: tuple[str, str], weight: str, value: str, prior: tuple[float, float]) -> str:
    """Rows with the Gaussian update of one parameter: mean and second moment over the rows of ``keys``, 0 where ``keep`` fails."""
    over = f"OVER (PARTITION BY {keys})"
    return f"""SELECT * EXCLUDE (m, p) REPLACE (CASE WHEN {keep} THEN m ELSE 0 END AS {names[0]}, CASE WHEN {keep} THEN m * m + 1 / p ELSE 0 END AS {names[1]})
      FROM (SELECT *, ({prior[0]} + sum({value}) {over}) / ({prior[1]} + sum({weight}) {over}) AS m, {prior[1]} + sum({weight}) {over} AS p FROM {table})"""


_STATE = f"{IDS}, sample, d, rate, tau, xx, xx2, pair, a, a2, b, b2, ya, ya2, yb, yb2, s, s2"
cte(
    "gfit",
    f"""WITH RECURSIVE fit AS (
      SELECT 0 AS sweep, {_STATE}, 'infinity'::DOUBLE AS change FROM {_at(0, 0, 0, 0, 0)} UNION ALL (
      WITH fold AS (SELECT * FROM fit WHERE change > {TOLERANCE} AND NOT isnan(change)),
      ffirst AS ({_mean("fold", "guide1", "gene1 <> 'CTRL'", ("a", "a2"), "tau * ya2", "tau * ya * (d - b * yb - xx * s)", (1, 1))}),
      fsecond AS ({_mean("ffirst", "guide2", "gene2 <> 'CTRL'", ("b", "b2"), "tau * yb2", "tau * yb * (d - a * ya - xx * s)", (1, 1))}),
      fgene AS (SELECT gene, sample, m AS y, m * m + 1 / p AS y2 FROM (
        SELECT gene, sample, 0.01 + sum(w) AS p, sum(r) / (0.01 + sum(w)) AS m FROM (
          SELECT gene1 AS gene, sample, tau * a2 AS w, tau * a * (d - b * yb - xx * s) AS r FROM fsecond UNION ALL
          SELECT gene2, sample, tau * b2, tau * b * (d - a * ya - xx * s) FROM fsecond) WHERE gene <> 'CTRL' GROUP BY ALL)),
      fgenes AS (SELECT r.* REPLACE (coalesce(u.y, 0) AS ya, coalesce(u.y2, 0) AS ya2, coalesce(v.y, 0) AS yb, coalesce(v.y2, 0) AS yb2),
        r.ya AS old_a, r.yb AS old_b, r.s AS old_s FROM fsecond r LEFT JOIN fgene u ON gene1 = u.gene AND r.sample = u.sample
        LEFT JOIN fgene v ON gene2 = v.gene AND r.sample = v.sample),
      fpair AS ({_mean("fgenes", "pair, sample", "pair IS NOT NULL", ("s", "s2"), "tau * xx2", "tau * xx * (d - a * ya - b * yb)", (0, 0.01))}),
      fboth AS ({_mean("fpair", IDS, "true", ("xx", "xx2"), "tau * s2", "tau * s * (d - a * ya - b * yb)", (1, 1))}),
      fnoise AS (SELECT * REPLACE (1 / (rate + 0.5 * ((d - a * ya - b * yb - xx * s) ** 2
          + a2 * ya2 - (a * ya) ** 2 + b2 * yb2 - (b * yb) ** 2 + xx2 * s2 - (xx * s) ** 2)) AS tau),
        max(greatest(abs(ya - old_a), abs(yb - old_b), abs(s - old_s))) OVER (PARTITION BY sample) AS moved,
        max(greatest(abs(ya), abs(yb), abs(s))) OVER (PARTITION BY sample) AS size FROM fboth)
      SELECT sweep + 1, {_STATE}, max(coalesce(moved / nullif(size, 0), 0)) OVER () FROM fnoise)) SELECT * FROM fit""",
)
cte("gend", "SELECT * FROM gfit WHERE sweep = (SELECT max(sweep) FROM gfit)")
cte(
    "gsettled",
    """SELECT pair, sample, max(s) AS s, max(CASE WHEN gene1 < gene2 THEN ya ELSE yb END) AS y_a, max(CASE WHEN gene1 < gene2 THEN yb ELSE ya END) AS y_b
       FROM gend WHERE pair IS NOT NULL GROUP BY pair, sample""",
)
cte(
    "ggene",
    """SELECT gene, sample, max(y) AS y FROM (SELECT gene1 AS gene, sample, ya AS y FROM gend UNION ALL SELECT gene2, sample, yb FROM gend)
       WHERE gene <> 'CTRL' GROUP BY gene, sample""",
)


def _vlong(spark, d):
    return stage(var.fold_changes(_stored(spark, d), LAYOUT), "fold-changes")


@query("median_lfc", f"SELECT {IDS}, sample, d FROM glfc", ["d"])
def median_lfc(spark, d):
    return var.fold_changes(_stored(spark, d), LAYOUT).drop("noise")


@query("variational_start", "SELECT pair, sample, s FROM gs_0", ["s"])
def variational_start(spark, d):
    pairs = var.initialise(_vlong(spark, d), CONTROL).pairs
    return pairs.select(pair_key(F.col("gene_a"), F.col("gene_b")).alias("pair"), "sample", "s")


@query("variational_effects", "SELECT pair, sample, s, y_a, y_b FROM gsettled", ["s", "y_a", "y_b"])
def variational_effects(spark, d):
    return var.effects(var.infer(_vlong(spark, d), CONTROL)).select("pair", "sample", "s", "y_a", "y_b")


@query(
    "variational_convergence",
    "SELECT e.sweep, e.sample, mae, change FROM ("
    + " UNION ALL ".join(f"SELECT {k}::INT AS sweep, sample, avg(abs(err)) AS mae FROM ge_{k} GROUP BY sample" for k in _SWEEPS)
    + ") e JOIN gchanges c ON e.sweep = c.sweep AND e.sample = c.sample WHERE e.sweep <= (SELECT stop FROM gstop)",
    ["mae", "change"],
)
def variational_convergence(spark, d):
    return var.convergence(var.infer(_vlong(spark, d), CONTROL, SWEEPS, tolerance=LOOSE))


@query(
    "variational_bound",
    "SELECT sweep, bound FROM gbounds WHERE sweep <= (SELECT stop FROM gstop)",
    ["bound"],
)
def variational_bound(spark, d):
    return var.bounds(var.infer(_vlong(spark, d), CONTROL, SWEEPS, tolerance=LOOSE, evidence=True))


@query(
    "variational_scores",
    f"""SELECT pair, e.sample, abs(s) - greatest(abs(y_a), abs(y_b)) AS strong,
          CASE WHEN least(y_a, y_b) >= threshold THEN least(y_a, y_b) - (y_a + y_b + s) END AS sensitive_lethality,
          CASE WHEN least(y_a, y_b) < threshold THEN (y_a + y_b + s) - least(y_a, y_b) END AS sensitive_recovery
        FROM gsettled e JOIN (SELECT sample, median(y) AS threshold FROM ggene WHERE gene IN ('{"', '".join(ESSENTIALS)}') GROUP BY sample) t
          ON e.sample = t.sample""",
    ["strong", "sensitive_lethality", "sensitive_recovery"],
)
def variational_scores(spark, d):
    model = var.infer(_vlong(spark, d), CONTROL)
    return var.scores(var.effects(model), var.positive_control_threshold(model, ESSENTIALS))


@query(
    "variational_scores_unbounded",
    """SELECT pair, sample, abs(s) - greatest(abs(y_a), abs(y_b)) AS strong, least(y_a, y_b) - (y_a + y_b + s) AS sensitive_lethality,
         NULL::DOUBLE AS sensitive_recovery FROM gsettled""",
    ["strong", "sensitive_lethality", "sensitive_recovery"],
)
def variational_scores_unbounded(spark, d):
    return var.scores(var.effects(var.infer(_vlong(spark, d), CONTROL)))
