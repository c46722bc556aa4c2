import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscreen.operators.ordered import bh_fdr, exact_quantiles, value_cell

QUANTILES = {"low": 0.025, "mid": 0.5, "high": 0.975}


def sample_values(kind, n, rng):
    if kind == "normal":
        return [rng.gauss(0, 1) for _ in range(n)]
    if kind == "ties":
        return [float(rng.choice([-2, 0, 0, 0, 3])) for _ in range(n)]
    if kind == "heavy":
        return [rng.gauss(0, 1) * 10 ** rng.uniform(-12, 12) for _ in range(n)]
    return [float(rng.randint(0, 500)) for _ in range(n)]


def test_quantiles_match_numpy(spark):
    rng = random.Random(1)
    groups = {
        (k, i): sample_values(k, n, rng)
        for k in ("normal", "ties", "heavy", "counts")
        for i, n in enumerate((1, 2, 7, 400))
    }
    rows = [(k, i, v) for (k, i), vs in groups.items() for v in vs] + [("normal", 0, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    out = exact_quantiles(df, ["k", "i"], "v", QUANTILES)
    got = {(r.k, r.i): r for r in out.collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key].n == len(values)
        for name, p in QUANTILES.items():
            want = np.percentile(values, 100 * p)
            assert got[key][name] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_quantiles_with_nan_null_keys_and_a_crowded_cell(spark):
    rng = random.Random(9)
    groups = {
        "a": [5.0 + rng.random() * 1e-9 for _ in range(3000)],
        None: [1.0, 2.0, 3.0, -1.0],
        "b": [float("inf"), float("-inf"), 0.0, -0.0, 7.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", float("nan")), (None, float("nan")), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"low": 0.1, "mid": 0.5}).collect()}
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key].n == len(values)
        assert got[key].mid == np.median(values)
    assert got["a"].low == pytest.approx(np.percentile(groups["a"], 10), rel=1e-15)


def test_cells_keep_order(spark):
    rng = random.Random(2)
    values = sorted(sample_values("heavy", 2000, rng) + [0.0, -0.0, 1e300, -1e300, 5e-324])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    cells = [r.c for r in df.select("i", value_cell(F.col("v")).alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells)


def adjust(ps):
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    out, low = [0.0] * len(ps), 1.0
    for rank in range(len(ps), 0, -1):
        i = order[rank - 1]
        low = min(low, ps[i] * len(ps) / rank)
        out[i] = low
    return out


def test_bh_matches_definition(spark):
    rng = random.Random(3)
    groups = {
        "a": [rng.random() ** 4 for _ in range(300)] + [0.0, 0.0, 1.0],
        "b": [0.5] * 20 + [0.01, 0.2],
        "c": [0.7],
    }
    rows = [(g, i, p) for g, ps in groups.items() for i, p in enumerate(ps)] + [("a", 999, None)]
    df = spark.createDataFrame(rows, "g string, i int, p double")
    got = {(r.g, r.i): r.fdr for r in bh_fdr(df, ["g"], "p").collect()}
    assert len(got) == len(rows)
    assert got.pop(("a", 999)) is None
    for g, ps in groups.items():
        for i, want in enumerate(adjust(ps)):
            assert got[g, i] == pytest.approx(want, rel=1e-12)


def test_adjusted_values_follow_p(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([("a", rng.random()) for _ in range(200)], "g string, p double")
    rows = sorted((r.p, r.fdr) for r in bh_fdr(df, ["g"], "p").collect())
    fdrs = [f for _, f in rows]
    assert fdrs == sorted(fdrs) and all(f >= p for p, f in rows)
