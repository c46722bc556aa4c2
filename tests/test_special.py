import math

import pytest
from pyspark.sql import functions as F

from duoscreen.functions.special import beta_inc, digamma, ln_gamma, t_two_sided_p, trigamma, trigamma_inverse

# Two-sided p-values of Student's t, from closed forms for 1 and 2 degrees of freedom and printed tables.
KNOWN = [(1.0, 1.0, 0.5), (0.0, 3.0, 1.0), (2.228, 10.0, 0.05), (2.0, 2.0, 1 - 2 / math.sqrt(6)), (1.96, 1e6, 0.05)]


def test_t_probability(spark):
    df = spark.createDataFrame([(i, t, d) for i, (t, d, _) in enumerate(KNOWN)], "i int, t double, d double")
    got = [r.p for r in df.select("i", t_two_sided_p(F.col("t"), F.col("d")).alias("p")).orderBy("i").collect()]
    for p, (_, _, want) in zip(got, KNOWN):
        assert p == pytest.approx(want, abs=2e-5)


def test_t_probability_against_quadrature(spark):
    cases = [(t, d) for t in (0.1, 0.9, 3.3, 12.0) for d in (1.7, 6.25, 80.5, 3000.0)]
    df = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(cases)], "i int, t double, d double")
    got = [r.p for r in df.select("i", t_two_sided_p(F.col("t"), F.col("d")).alias("p")).orderBy("i").collect()]
    for p, (t, d) in zip(got, cases):
        n, end = 20000, math.atan(t / math.sqrt(d))
        area = sum(
            (1 if i in (0, n) else 4 if i % 2 else 2) * math.cos(end * i / n) ** (d - 1) for i in range(n + 1)
        ) * end / n / 3
        scale = math.exp(math.lgamma((d + 1) / 2) - math.lgamma(d / 2)) / math.sqrt(math.pi)
        assert p == pytest.approx(1 - 2 * scale * area, abs=1e-10)


def test_t_probability_with_very_many_degrees(spark):
    cases = [(t, d) for t in (0.3, 1.96, 5.0) for d in (1e9, 1e11, 1e13)]
    df = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(cases)], "i int, t double, d double")
    got = [r.p for r in df.select("i", t_two_sided_p(F.col("t"), F.col("d")).alias("p")).orderBy("i").collect()]
    for p, (t, _) in zip(got, cases):
        assert p == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-7)


def test_missing_inputs_give_null(spark):
    df = spark.createDataFrame([(None, 2.0), (1.0, None), (1.0, 0.0)], "t double, d double")
    assert [r[0] for r in df.select(t_two_sided_p(F.col("t"), F.col("d"))).collect()] == [None, None, None]


def test_gamma_family(spark):
    xs = [0.5, 1.0, 2.5, 17.0, 400.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    x = F.col("x")
    for r in df.select(
        "x", ln_gamma(x).alias("lg"), digamma(x).alias("d"), trigamma(x).alias("t"), trigamma_inverse(trigamma(x)).alias("i")
    ).collect():
        assert r.lg == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12)
        h = 1e-4 * r.x
        assert r.d == pytest.approx((math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h), rel=1e-5, abs=1e-5)
        assert r.i == pytest.approx(r.x, rel=1e-9)
    one = df.where("x = 1").select(digamma(x), trigamma(x)).first()
    assert one[0] == pytest.approx(-0.5772156649015329) and one[1] == pytest.approx(math.pi**2 / 6)


def test_beta_symmetry(spark):
    df = spark.createDataFrame([(a, b, x) for a in (0.5, 2.0, 9.5) for b in (0.5, 3.0) for x in (0.1, 0.5, 0.93)], "a double, b double, x double")
    a, b, x = F.col("a"), F.col("b"), F.col("x")
    for (total,) in df.select(beta_inc(a, b, x) + beta_inc(b, a, 1 - x)).collect():
        assert total == pytest.approx(1.0, abs=1e-12)
