"""Ranks counted along written ranges, the tests built on them, and local regression."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscreen.functions.special import normal_two_sided_p
from duoscreen.operators.ordered import bh_fdr, in_ranges, rank_sums
from duoscreen.operators.smooth import local_trend
from duoscreen.operators.stats import rank_sum_test
from duoscreen.plans import moderated_gi
from test_ordered import adjust


def plain_rank_sum(a, b):
    merged = sorted(a + b)
    midrank = lambda v: merged.index(v) + (merged.count(v) + 1) / 2
    u = sum(map(midrank, a)) - len(a) * (len(a) + 1) / 2
    n, m = len(a), len(b)
    ties = sum(merged.count(v) ** 2 - 1 for v in merged)
    var = n * m / 12 * ((n + m + 1) - ties / ((n + m) * (n + m - 1)))
    if var <= 0:
        return u, None, None
    d = u - n * m / 2
    z = (d - 0.5 * ((d > 0) - (d < 0))) / math.sqrt(var)
    return u, z, min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def test_rank_sums_with_ties_single_rows_and_null_keys(spark):
    rng = random.Random(2)
    groups = {
        ("a", 1): ([rng.gauss(0, 1) for _ in range(200)], [rng.gauss(0.3, 1) for _ in range(200)]),
        ("a", 2): ([float(rng.randrange(4)) for _ in range(60)], [float(rng.randrange(5)) for _ in range(60)]),
        (None, 1): ([1.0], [2.0]),
        ("b", None): ([1.0, 1.0, 0.0], [-0.0, 1.0, 5.0]),
        ("c", 1): ([3.0, 3.0], [3.0, 3.0]),
    }
    rows = [(k, i, x, y) for (k, i), (xs, ys) in groups.items() for x, y in zip(xs, ys)] + [("d", 1, None, None), ("a", 2, None, float("nan"))]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double").repartition(5)
    got = {(r.k, r.i): r for r in rank_sum_test(df, ["k", "i"], "x", "y").collect()}
    assert set(got) == set(groups)
    for key, (xs, ys) in groups.items():
        u, z, p = plain_rank_sum(xs, ys)
        r = got[key]
        assert (r.n1, r.n2) == (len(xs), len(ys)) and r.u == pytest.approx(u)
        assert (r.z, r.p_val) == (None, None) if z is None else (r.z == pytest.approx(z) and r.p_val == pytest.approx(p, rel=1e-11))


def test_samples_of_unequal_size(spark):
    df = spark.createDataFrame([("g", 1.0, 5.0), ("g", 7.0, None), ("g", None, 6.0), ("g", None, 7.0)], "k string, x double, y double")
    r = rank_sum_test(df, ["k"], "x", "y").first()
    assert (r.n1, r.n2) == (2, 3) and r.u == plain_rank_sum([1.0, 7.0], [5.0, 6.0, 7.0])[0] == 2.5


def test_no_window_over_a_whole_group(spark):
    df = spark.createDataFrame([("g", float(i), float(i)) for i in range(50)], "k string, x double, y double")
    plan = rank_sums(df, ["k"], "x", "y")._jdf.queryExecution().analyzed().toString()
    windows = [w for w in plan.split("\n") if "Window [" in w]
    # by value only inside a range; along a group only over its ranges
    assert len(windows) == 2 and sum("_v#" in w.split("windowspecdefinition")[1] and "_range#" in w.split("windowspecdefinition")[1] for w in windows) == 1


def test_normal_tail(spark):
    values = [0.0, 1e-9, 0.3, -1.0, 1.9, 2.0, 2.828, 2.83, 3.5, 6.0, -9.0, 20.0, 37.0]
    df = spark.createDataFrame([(z,) for z in values], "z double")
    for r in df.select("z", normal_two_sided_p(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-12)


def test_bh_with_null_keys_and_half_of_the_rows_at_one(spark):
    rng = random.Random(6)
    groups = {(None, 1): [0.01, 0.2], ("a", None): [1.0] * 400 + [rng.random() for _ in range(400)], ("a", 1): [1.0] * 300, ("b", 2): [0.04, 0.04, 0.04, 0.5]}
    rows = [(k, i, p) for (k, i), ps in groups.items() for p in ps] + [("a", 1, None)] * 7 + [(None, None, None)]
    got = bh_fdr(spark.createDataFrame(rows, "k string, i int, p double").repartition(3), ["k", "i"], "p").collect()
    assert len(got) == len(rows) and sum(r.fdr is None for r in got) == 8
    for (k, i), ps in groups.items():
        mine = sorted((r.p, r.fdr) for r in got if (r.k, r.i) == (k, i) and r.p is not None)
        assert [f for _, f in mine] == pytest.approx([w for _, w in sorted(zip(ps, adjust(ps)))], rel=1e-12)


def test_ranges_part_equal_values(spark):
    """Half of the rows share one p: they lie in several ranges, none much larger than another."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "10")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = session.range(20_000).select(F.lit("g").alias("k"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.rand(1)).alias("p"), "id")
    sizes = [r["count"] for r in in_ranges(df, ["k"], ["p", "id"]).groupBy("_range").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * statistics.median(sizes)


def plain_trend(xs, ys, q, knots, reach):
    low, step = min(xs), (max(xs) - min(xs)) / (knots - 1)

    def at(k):
        u = (xs - (low + k * step)) / (reach * step)
        w = np.where(abs(u) < 1, (1 - abs(u) ** 3) ** 3, 0)
        s = w.sum()
        a, b = (w * u).sum() / s, (w * ys).sum() / s
        var = (w * u * u).sum() / s - a * a
        return b - a * ((w * u * ys).sum() / s - a * b) / var if var > 1e-9 else b

    t = (q - low) / step
    j = min(max(math.floor(t), 0), knots - 2)
    return at(j) + (0 if t == j else (at(j + 1) - at(j)) * (t - j))


@pytest.mark.parametrize("knots, reach", [(41, 12), (11, 2), (5, 30)])
def test_local_trend_equals_weighted_sums(spark, knots, reach):
    rng = random.Random(7)
    rows = [("a", x, math.sin(2 * x) + rng.gauss(0, 0.1)) for x in [rng.gauss(0, 1) for _ in range(300)]]
    rows += [("line", i * 0.37 - 5, 4 - 3 * (i * 0.37 - 5)) for i in range(80)] + [(None, 2.0, 5.0), (None, 2.0, 7.0), ("gap", 0.0, 1.0), ("gap", 1.0, 9.0)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("a", 0.5, None)], "g string, x double, y double")
    got = local_trend(df, "g", "x", "y", knots=knots, reach=reach).collect()
    assert len(got) == len(rows) + 2
    xs, ys = (np.array(c) for c in zip(*[(x, y) for g, x, y in rows if g == "a"]))
    for r in got:
        if r.x is None:
            assert r.trend is None
        elif r.g == "a":
            assert r.trend == pytest.approx(plain_trend(xs, ys, r.x, knots, reach), abs=1e-10)
        elif r.g == "line":
            assert r.trend == pytest.approx(r.y, abs=1e-9)
        elif r.g is None:
            assert r.trend == 6.0
        elif reach < knots - 1:
            assert r.trend == pytest.approx(r.y, abs=1e-9)


def test_tests_of_the_moderated_score(spark, constructs):
    from duoscreen.screen import Layout

    layout = Layout(samples={"L": ["r1", "r2"]}, t0="t0", control="CTRL")
    ranked = moderated_gi.moderated_gi(constructs, layout, test="rank-sum").collect()
    assert {r.gene_pair for r in ranked} == {"A_B", "A_C", "B_C"} and all(r.n == 8 and 0 < r.p_val <= r.fdr <= 1 for r in ranked)
    flat = moderated_gi.moderated_gi(constructs, layout, loess=True)
    assert {r.gene_pair for r in flat.collect()} == {"A_B", "A_C", "B_C"}
    for wrong in ({"test": "t"}, {"test": "rank-sum", "loess": True}):
        with pytest.raises(ValueError):
            moderated_gi.moderated_gi(constructs, layout, **wrong)
