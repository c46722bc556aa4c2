"""Composite scores against direct definitions on small screens."""

import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscreen.operators.effects import pair_medians
from duoscreen.operators.normalize import control_scaled
from duoscreen.operators.stats import gaussian_kde, histogram, moderated_t, quadratic_fit, trimmed_z
from duoscreen.plans import delta_lfc, moderated_gi, quadratic_gi, regression_gi, variational_gi
from duoscreen.screen import Layout
from duoscreen.session import stage

LAYOUT = Layout(samples={"L": ["r1", "r2"]}, t0="t0")


def test_zdlfc_ignores_position_of_genes(spark, constructs):
    swapped = constructs.select(
        F.col("gene2").alias("gene1"), F.col("gene1").alias("gene2"), F.col("guide2").alias("guide1"),
        F.col("guide1").alias("guide2"), "t0", "r1", "r2",
    )
    one = {r.gene_pair: r for r in delta_lfc.zdlfc(constructs, LAYOUT).collect()}
    two = {r.gene_pair: r for r in delta_lfc.zdlfc(swapped, LAYOUT).collect()}
    assert set(one) == set(two) == {"A_A", "A_B", "A_C", "B_B", "B_C", "C_C"}
    for k, r in one.items():
        assert r.dlfc == pytest.approx(two[k].dlfc) and r.zdlfc == pytest.approx(two[k].zdlfc)


def test_trimmed_z_of_its_own_output_is_identity(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("L", float(v)) for v in rng.normal(3, 2, 400)], "sample string, v double")
    once = trimmed_z(df, "v", name="z")
    for r in trimmed_z(once, "z", name="zz").collect():
        assert r.zz == pytest.approx(r.z, abs=1e-9)


def test_pair_median_of_hot_pair(spark, constructs):
    long = delta_lfc.sample_fold_changes(constructs, LAYOUT)
    values = {}
    for r in long.where("gene1 != 'CTRL' AND gene2 != 'CTRL'").collect():
        values.setdefault((min(r.gene1, r.gene2), max(r.gene1, r.gene2), r.sample), []).append(r.lfc)
    got = {(r.gene_a, r.gene_b, r.sample): r.pair_median for r in pair_medians(long, "CTRL").collect()}
    assert set(got) == set(values)
    for key, own in values.items():
        assert got[key] == pytest.approx(np.median(own), abs=1e-12)


def test_control_scaling_sets_class_medians(spark):
    rng = np.random.default_rng(1)
    rows = [("r", c, float(rng.normal(m, 1))) for c, m in (("NC", 0.3), ("PC", -2), ("DT", -1)) for _ in range(51)]
    df = control_scaled(spark.createDataFrame(rows, "rep string, target_class string, lfc double"))
    mid = {r[0]: r[1] for r in df.groupBy("target_class").agg(F.median("lfc_scaled")).collect()}
    assert mid["NC"] == pytest.approx(0, abs=1e-12) and mid["PC"] == pytest.approx(-1, abs=1e-12)


@pytest.fixture(scope="module")
def score_rows():
    """Scored constructs: singles with several controls per guide, doubles, and control pairs."""
    rng = np.random.default_rng(2)
    rows = []

    def add(cls, g1, g2, s1, s2):
        rows.append((g1, g2, s1, s2, cls, f"{g1}_{g2}", "r", float(rng.normal(-1 if cls != "NC" else 0, 0.5))))

    for g, i, c in itertools.product("ABC", range(3), range(4)):
        add("ST", g, "NT", f"{g}{i}", f"n{c}")
        if c < 2:
            add("ST", g, "NT", f"{g}{i}", f"n{c}")
    for c, k in itertools.product(range(3), range(3)):
        add("NC", "NT", "NT", f"n{c}", f"n{k}")
    for (g, h), i, j in itertools.product((("A", "B"), ("A", "C"), ("B", "C")), range(3), range(3)):
        add("DT", g, h, f"{g}{i}", f"{h}{j}")
    return rows


def test_single_sums_equal_explicit_matching(spark, score_rows):
    schema = "gene1 string, gene2 string, guide1 string, guide2 string, target_class string, paralog_pair string, rep string, crispr_score double"
    scores = spark.createDataFrame(score_rows, schema)
    singles = [r for r in score_rows if r[4] == "ST"]
    control = {}
    for r in score_rows:
        if r[4] == "NC":
            for guide in r[2:4]:
                control.setdefault(guide, []).append(r[7])
    matched = [
        (a[0], a[2], a[3], a[7], b[7] + statistics.fmean(control[a[3]]))
        for a in singles
        for b in singles
        if a[5] == b[5] and a[2] == b[2] and a[3] != b[3] and a[3] in control
    ]
    by_gene = {}
    for m in matched:
        by_gene.setdefault(m[0], []).append(m)
    xs = [statistics.fmean(m[4] for m in ms) for ms in by_gene.values()]
    ys = [statistics.fmean(m[3] for m in ms) for ms in by_gene.values()]
    slope, intercept = np.polyfit(xs, ys, 1)

    table = regression_gi.single_expected(scores, "NT")
    fit = regression_gi.single_fit(table)
    row = fit.first()
    assert row.slope == pytest.approx(slope) and row.intercept == pytest.approx(intercept)

    gi = [m[3] - (intercept + slope * m[4]) for m in matched]
    pool = regression_gi.single_pool(regression_gi.single_gi(table, fit)).first()
    assert pool.pool_n == len(gi)
    assert pool.pool_mean == pytest.approx(statistics.fmean(gi), abs=1e-9)
    assert pool.pool_var == pytest.approx(statistics.variance(gi), rel=1e-9)

    doubles = regression_gi.double_gi(regression_gi.double_expected(scores, "NT"), fit)
    tests = {r.paralog_pair: r for r in regression_gi.pair_tests(doubles, regression_gi.single_gi(table, fit)).collect()}
    singles_mean = {}
    for r in singles:
        singles_mean.setdefault(r[2], []).append(r[7])
    for pair in ("A_B", "A_C", "B_C"):
        own = [
            r[7] - (intercept + slope * (statistics.fmean(singles_mean[r[2]]) + statistics.fmean(singles_mean[r[3]])))
            for r in score_rows
            if r[5] == pair
        ]
        a, b = statistics.variance(gi) / len(gi), statistics.variance(own) / len(own)
        t = (statistics.fmean(gi) - statistics.fmean(own)) / math.sqrt(a + b)
        assert tests[pair].t == pytest.approx(t, rel=1e-6)
        assert tests[pair].df == pytest.approx((a + b) ** 2 / (a * a / (len(gi) - 1) + b * b / (len(own) - 1)), rel=1e-6)


def test_observed_mode_fits_the_identity(spark, score_rows):
    schema = "gene1 string, gene2 string, guide1 string, guide2 string, target_class string, paralog_pair string, rep string, crispr_score double"
    scores = spark.createDataFrame(score_rows, schema)
    fit = regression_gi.single_fit(regression_gi.single_expected(scores, "NT", "observed")).first()
    assert fit.slope == pytest.approx(1) and fit.intercept == pytest.approx(0, abs=1e-9)


def test_quadratic_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x), float(rng.normal())) for g in "ab" for x in rng.normal(size=20)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    fit = quadratic_fit(df, ["g"], F.col("x"), F.col("y"), F.lit(0.25))
    res = df.join(fit, "g").withColumn("e", F.expr("y - m0 * x * x - m1 * x - 0.25"))
    for r in res.groupBy("g").agg(F.sum(F.expr("e * x")).alias("a"), F.sum(F.expr("e * x * x")).alias("b")).collect():
        assert r.a == pytest.approx(0, abs=1e-9) and r.b == pytest.approx(0, abs=1e-9)


def test_quadratic_fit_without_spread(spark):
    df = spark.createDataFrame([("a", 2.0, 6.0), ("a", 2.0, 8.0), ("b", 0.0, 1.0)], "g string, x double, y double")
    got = {r.g: (r.m0, r.m1) for r in quadratic_fit(df, ["g"], F.col("x"), F.col("y"), F.lit(1.0)).collect()}
    assert got == {"a": (0.0, 3.0), "b": (0.0, 0.0)}


def test_quadratic_fit_of_close_values_against_rationals(spark):
    """x = 1 + i * 1e-9 and a few wider groups: the exact least squares of the same doubles."""
    from fractions import Fraction

    groups = {k: [1 + i * step for i in range(12)] for k, step in (("9", 1e-9), ("8", 1e-8), ("6", 1e-6), ("3", 1e-3), ("wide", 1.0))}
    groups[None] = [-3.0, -3.0 + 1e-9, 0.0, -3.0 - 4e-9]
    rows = [(k, x, 2 * x * x - x + 0.5) for k, xs in groups.items() for x in xs]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: (r.m0, r.m1) for r in quadratic_fit(df, ["g"], F.col("x"), F.col("y"), F.lit(0.5)).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        pairs = [(Fraction(x), Fraction(2 * x * x - x + 0.5) - Fraction(1, 2)) for x in xs]
        s2, s3, s4 = (sum(x**p for x, _ in pairs) for p in (2, 3, 4))
        t1, t2 = sum(x * r for x, r in pairs), sum(x * x * r for x, r in pairs)
        det = s4 * s2 - s3 * s3
        m0, m1 = float((t2 * s2 - t1 * s3) / det), float((s4 * t1 - s3 * t2) / det)
        assert got[k] == pytest.approx((m0, m1), rel=1e-4), k


def dense_scores(rows, truncate):
    """Guide-by-guide matrices filled query by query."""
    guides = sorted({r[2] for r in rows} | {r[3] for r in rows})
    at = {g: i for i, g in enumerate(guides)}
    a, b = np.zeros(len(guides)), np.zeros(len(guides))
    for g in guides:
        own = [r[4] for r in rows if r[2] == g and r[1] == "CTRL" and r[5] != "Dual"]
        a[at[g]] = np.mean(own) if own else 0
        own = [r[4] for r in rows if r[3] == g and r[0] == "CTRL" and r[5] != "Dual"]
        b[at[g]] = np.mean(own) if own else 0
    one, two = np.zeros((len(guides),) * 2), np.zeros((len(guides),) * 2)
    for q in guides:
        for matrix, mine, other, gene, x, offset, cut in ((one, 3, 2, 0, a, b, truncate), (two, 2, 3, 1, b, a, False)):
            sel = [r for r in rows if r[mine] == q]
            if not sel:
                continue
            xs = np.array([x[at[r[other]]] for r in sel])
            ys = np.array([r[4] for r in sel]) - offset[at[q]]
            m = np.linalg.lstsq(np.column_stack([xs**2, xs]), ys, rcond=None)[0]
            res = ys - m[0] * xs**2 - m[1] * xs
            ctrl = np.array([r[gene] == "CTRL" for r in sel])
            if ctrl.any() and res[ctrl].std() != 0:
                res = res / res[ctrl].std()
            matrix[at[q], [at[r[other]] for r in sel]] = np.trunc(res) if cut else res
    mean = (one + two) / 2
    mean = (mean + mean.T) / 2
    return {(r[2], r[3]): mean[at[r[2]], at[r[3]]] for r in rows}


@pytest.mark.parametrize("truncate", [True, False])
def test_quadratic_score_equals_dense_matrix(spark, constructs, truncate):
    small = constructs.where("NOT (gene1 = 'B' AND gene2 = 'A' AND guide1 = 'B.0')")
    long = quadratic_gi.construct_phenotypes(small, LAYOUT, threshold=0)
    rows = [(r.gene1, r.gene2, r.guide1, r.guide2, r.fc, r.arity) for r in long.collect()]
    want = dense_scores(rows, truncate)
    got = {(r.guide1, r.guide2): r.gi for r in quadratic_gi.construct_gi(long, "CTRL", truncate).collect()}
    assert set(got) == set(want)
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-7)


def test_moderated_t_shrinks_towards_prior(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        sd = math.exp(rng.normal(0, 0.8))
        values = rng.normal(0.2, sd, 6)
        rows.append(("L", f"p{i}", float(values.mean()), float(values.var(ddof=1)), 6))
    df = spark.createDataFrame(rows, "sample string, pair string, m double, v double, n int")
    out = moderated_t(df, "sample", "m", "v", "n").collect()
    assert all(r.d0 > 0 and 0 <= r.p_val <= 1 for r in out)
    for r in out:
        post = (r.d0 * r.s02 + 5 * r.v) / (r.d0 + 5)
        assert min(r.v, r.s02) <= post <= max(r.v, r.s02)
        assert r.t == pytest.approx(r.m / math.sqrt(post / 6))


def test_moderated_t_with_equal_variances_uses_the_prior_alone(spark):
    rows = [("L", f"p{i}", 0.1 * i, 1.0, 5) for i in range(10)]
    df = spark.createDataFrame(rows, "sample string, pair string, m double, v double, n int")
    for r in moderated_t(df, "sample", "m", "v", "n").collect():
        assert r.d0 is None and r.df == 40.0


def test_calls(spark):
    df = spark.createDataFrame([(0.1, -0.6), (0.1, 0.6), (0.3, -0.6), (0.1, 0.4), (None, 0.9)], "fdr double, effect double")
    assert [r.call for r in moderated_gi.call_hits(df).collect()] == ["Sensitizer", "Suppressor", "None", "None", "None"]


def test_variational_model_recovers_effects(spark):
    rng = np.random.default_rng(7)
    effect = {"CTRL": 0.0, "A": -2.0, "B": -0.5, "C": 1.0, "D": -1.0}
    extra = {("A", "B"): -1.5, ("C", "D"): 1.0}
    rows = []
    for g, h in itertools.product(effect, effect):
        for i, j in itertools.product(range(4), range(4)):
            if g != h:
                true = effect[g] + effect[h] + extra.get((g, h), extra.get((h, g), 0.0))
                rows.append((g, h, f"{g}{i}", f"{h}{j}", "L", float(true + rng.normal(0, 0.05))))
    long = spark.createDataFrame(rows, "gene1 string, gene2 string, guide1 string, guide2 string, sample string, d double")
    model = variational_gi.infer(long, "CTRL", 4, variational_gi.Priors(rate=0.005), tolerance=0.0)
    mae = [r.mae for r in variational_gi.convergence(model).orderBy("sweep").collect()]
    assert len(mae) == 4 and mae[-1] < 0.04 and mae[-1] <= mae[0]
    pairs = variational_gi.effects(model)
    rows = pairs.collect()
    assert len(rows) == 6
    for r in rows:
        a, b = r.pair.split("_")
        assert r.y_a + r.y_b + r.s == pytest.approx(effect[a] + effect[b] + extra.get((a, b), 0.0), abs=0.3)
    scored = variational_gi.scores(pairs)
    assert scored.where("sensitive_recovery IS NOT NULL").count() == 0
    for r in scored.join(pairs, ["pair", "sample"]).collect():
        assert r.strong == pytest.approx(abs(r.s) - max(abs(r.y_a), abs(r.y_b)))
        assert r.sensitive_lethality == pytest.approx(min(r.y_a, r.y_b) - (r.y_a + r.y_b + r.s))


def test_variational_bound_rises_with_defaults_and_old_tables_go(spark, tmp_path, monkeypatch):
    from duoscreen.catalog.screens import LAYOUT as SCREEN, _stored

    monkeypatch.setattr("duoscreen.session.shared_dir", lambda _: str(tmp_path))
    long = stage(variational_gi.fold_changes(_stored(spark, "/root/testdata/sf0.01"), SCREEN), "long")
    tables = len(spark.catalog.listTables())
    model = variational_gi.infer(long, "CTRL", evidence=True)
    found = [r.bound for r in variational_gi.bounds(model).orderBy("sweep").collect()]
    assert len(found) > 2 and found == sorted(found)
    kept = [p.name.split("-")[0] for p in (tmp_path / "duoscreen").iterdir()]
    assert kept.count("doubles") == 1 and kept.count("genes") == 1 and kept.count("x") == 2
    assert not [k for k in kept if k.startswith("duoscreen_rows")] and len(spark.catalog.listTables()) == tables


def test_gene_names_with_underscores(spark):
    rng = np.random.default_rng(11)
    genes = ["CTRL", "HLA_A", "HLA", "A_B", "B"]
    rows = [(g, h, f"{g}{i}", f"{h}{j}", "L", float(rng.normal())) for g in genes for h in genes if g != h for i in range(2) for j in range(2)]
    long = spark.createDataFrame(rows, "gene1 string, gene2 string, guide1 string, guide2 string, sample string, d double")
    fitted = variational_gi.effects(variational_gi.infer(long, "CTRL", 1, variational_gi.Priors(rate=0.1)))
    assert fitted.count() == 6 and fitted.where("y_a IS NULL OR y_b IS NULL OR s IS NULL").count() == 0


def test_quadratic_score_averages_counts_before_the_fold_change(spark):
    rows = [("CTRL", "CTRL", "c1", "c2", 100.0, 100.0, 100.0, 100.0), ("A", "B", "a1", "b1", 100.0, 1.0, 10.0, 400.0), ("B", "A", "b1", "a1", 100.0, None, 10.0, 400.0)]
    df = spark.createDataFrame(rows, "gene1 string, gene2 string, guide1 string, guide2 string, t0 double, r1 double, r2 double, r3 double")
    layout = Layout(samples={"L": ["r1", "r2", "r3"]}, t0="t0")
    got = {(r.gene1, r.gene2): r.fc for r in quadratic_gi.construct_phenotypes(df, layout, threshold=0).collect()}
    one, two = (1 + 10 + 400) / 3, (0 + 10 + 400) / 3
    change = [(math.log2((late + 10) / 110) - math.log2((100 + 10) / 110)) / 6.3 for late in (one, two)]
    assert got["A", "B"] == pytest.approx(sum(change) / 2, abs=1e-12) and got["A", "B"] > 0


def test_repeated_guide_pair_counts_once(spark, constructs):
    long = quadratic_gi.construct_phenotypes(constructs, LAYOUT, threshold=0)
    again = long.unionByName(long.where("guide1 = 'A.0' AND guide2 = 'B.0'"))
    own = {(r.guide1, r.guide2): r for r in quadratic_gi.construct_gi(again, "CTRL", False).collect()}
    pair = own["A.0", "B.0"]
    back = own["B.0", "A.0"]
    assert pair.gi == pytest.approx((pair.score_a + pair.score_b + back.score_a + back.score_b) / 4)


def test_moderated_residuals_and_audit(spark):
    rows = [("A", "CTRL", 1.0), ("CTRL", "B", 2.0), ("A", "B", 5.0), ("B", "A", 6.0), ("A", "C", 7.0)]
    long = spark.createDataFrame([(g, h, g + "1", h + "1", "L", v) for g, h, v in rows], "gene1 string, gene2 string, guide1 string, guide2 string, sample string, lfc double")
    got = {(r.gene1, r.gene2): r.residual for r in moderated_gi.pair_residuals(long, "CTRL").collect()}
    assert got == {("A", "B"): 2.0, ("B", "A"): 3.0}
    assert [(r.gene1, r.gene2) for r in moderated_gi.unscored_constructs(long, "CTRL").collect()] == [("A", "C")]
    ordered = {(r.gene1, r.gene2) for r in moderated_gi.pair_residuals(long, "CTRL", ignore_orientation=False).collect()}
    assert ordered == {("A", "B")}


def test_excluded_constructs_count_for_the_mean(spark, constructs):
    every = {tuple(r)[:5]: r.lfc for r in delta_lfc.sample_fold_changes(constructs, LAYOUT).collect()}
    kept = {tuple(r)[:5]: r.lfc for r in delta_lfc.sample_fold_changes(constructs, LAYOUT, keep=F.col("gene1") != "C").collect()}
    assert kept == {k: v for k, v in every.items() if k[0] != "C"} and len(kept) < len(every)


def test_trimmed_z_of_its_own_result_is_the_same(spark):
    """As in the published table of 403 pairs: the values inside the percentiles have mean 0 and sd 1, so nothing changes."""
    rng = np.random.default_rng(403)
    df = spark.createDataFrame([(c, float(v)) for c in ("A549", "HT29") for v in rng.standard_t(3, size=403)], "sample string, dlfc double")
    once = stage(trimmed_z(df, "dlfc", name="z"), "z")
    twice = trimmed_z(once, "z", name="zz").collect()
    assert len(twice) == 806 and all(r.zz == pytest.approx(r.z, abs=1e-12) for r in twice)
    inside = [r.z for r in twice if r.sample == "A549"]
    low, high = np.percentile(inside, [2.5, 97.5])
    kept = [z for z in inside if low < z < high]
    assert len(kept) == 381 and abs(np.mean(kept)) < 1e-12 and np.std(kept, ddof=1) == pytest.approx(1)


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([("L", float(v)) for v in rng.normal(size=300)], "sample string, v double")
    rows = gaussian_kde(df, "v", "sample").orderBy("point").collect()
    assert len(rows) == 500
    assert sum(r.density for r in rows) * 20 / 499 == pytest.approx(1, abs=1e-3)
    bins = histogram(df, "v", "sample").collect()
    assert sum(r.n for r in bins) == 300 and max(r.bin for r in bins) == 29


def test_density_equals_the_sum_of_all_kernels(spark):
    """Within the stated 3e-13 of the rows, for narrow, wide, far and constant groups."""
    rng = np.random.default_rng(16)
    groups = {"n": rng.normal(size=400), "narrow": 3 + 1e-3 * rng.normal(size=50), "wide": 40 * rng.normal(size=200), None: rng.choice([-4.0, 0.0, 6.0], 30)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("n", None), ("n", float("nan")), ("one", 2.0), ("same", 1.0), ("same", 1.0)]
    got = gaussian_kde(spark.createDataFrame(rows, "sample string, v double"), "v", "sample").collect()
    assert len(got) == 500 * 6
    for r in got:
        if r.sample in ("one", "same"):
            assert r.density is None
            continue
        v = groups[r.sample]
        h = np.std(v, ddof=1) * len(v) ** -0.2
        exact = np.exp(-(((r.x - v) / h) ** 2) / 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
        assert abs(r.density - exact) * h * math.sqrt(2 * math.pi) <= 3e-13


def test_density_rows_per_input_row_do_not_grow_with_the_grid(spark):
    df = spark.range(1000).select(F.lit("s").alias("sample"), (F.col("id") / 500.0 - 1).alias("v"))
    plans = [gaussian_kde(df, "v", "sample", points=p)._jdf.queryExecution().optimizedPlan().toString() for p in (10, 5000)]
    for plan in plans:  # points are made from bins, above the aggregate
        lines = plan.split("\n")
        explode = max(i for i, x in enumerate(lines) if "Generate explode" in x)
        assert any("Aggregate" in x and "_bin#" in x for x in lines[explode:])


@pytest.mark.parametrize("expected", ["other_control", "observed"])
def test_pool_of_single_residuals_under_a_large_shift(spark, expected):
    """Scores far from zero keep the spread of their residuals."""
    rng = np.random.default_rng(12)
    rows = []
    for gene in "AB":
        for guide in range(3):
            for control in range(4):
                for _ in range(2):
                    rows.append(("r", f"{gene}_CTRL", gene, "CTRL", f"{gene}{guide}", f"c{control}", "ST", round(float(rng.normal()), 3)))
    for i in range(4):
        for j in range(4):
            rows.append(("r", "CTRL_CTRL", "CTRL", "CTRL", f"c{i}", f"c{j}", "NC", round(float(rng.normal()), 3)))
    schema = "rep string, paralog_pair string, gene1 string, gene2 string, guide1 string, guide2 string, target_class string, crispr_score double"
    fit = spark.createDataFrame([("r", 0.25, 0.5)], "rep string, slope double, intercept double")
    pools = []
    for shift in (0.0, 1e8):
        df = spark.createDataFrame([(*r[:-1], r[-1] + shift) for r in rows], schema)
        pools.append(regression_gi.single_pool(regression_gi.single_gi(regression_gi.single_expected(df, "CTRL", expected), fit)).first())
    assert pools[0].pool_n == pools[1].pool_n
    assert pools[1].pool_var == pytest.approx(pools[0].pool_var, rel=1e-6) and pools[0].pool_var > 0.01
