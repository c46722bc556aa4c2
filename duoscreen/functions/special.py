"""Special functions as native column expressions (no Python in the data path)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos approximation of ln gamma, g = 7, n = 9.
LANCZOS_G = 7.0
LANCZOS = [
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
]

_TINY = 1e-300
TERMS = 120


def ln_gamma(x: Column) -> Column:
    """ln gamma for x > 0.5."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (z + i)
    base = z + (LANCZOS_G + 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(base) - base + F.log(series)


def digamma(x: Column) -> Column:
    """Derivative of ln gamma for x > 0: recurrence up by 10, then the asymptotic series."""
    shifted = x + 10
    out = F.log(shifted) - F.lit(0.5) / shifted
    inv2 = F.lit(1.0) / (shifted * shifted)
    out = out - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 * (1 / 132)))))
    for k in range(10):
        out = out - F.lit(1.0) / (x + k)
    return out


def trigamma(x: Column) -> Column:
    """Second derivative of ln gamma for x > 0."""
    shifted = x + 10
    inv = F.lit(1.0) / shifted
    inv2 = inv * inv
    out = inv + inv2 / 2 + inv * inv2 * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 * (1 / 30 - inv2 * (5 / 66)))))
    for k in range(10):
        out = out + F.lit(1.0) / ((x + k) * (x + k))
    return out


def _tetragamma(x: Column) -> Column:
    """Third derivative of ln gamma, negative for x > 0."""
    shifted = x + 10
    inv = F.lit(1.0) / shifted
    inv2 = inv * inv
    out = -inv2 - inv2 * inv - inv2 * inv2 * (0.5 - inv2 * (1 / 6 - inv2 * (1 / 6 - inv2 * 0.3)))
    for k in range(10):
        out = out - F.lit(2.0) / ((x + k) * (x + k) * (x + k))
    return out


def trigamma_inverse(y: Column, steps: int = 30) -> Column:
    """x with trigamma(x) = y, for y > 0: Newton steps on 1/trigamma, which is nearly linear."""
    start = F.lit(0.5) + F.lit(1.0) / y

    def step(x, _):
        value = trigamma(x)
        return x + value * (F.lit(1.0) - value / y) / _tetragamma(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, by the modified Lentz method.

    One term per step; the parameters ride along in the state, so that they are computed once per row. With one
    parameter at 1/2, the case of the t distribution, 70 terms reach 1e-11 for any value of the other.
    """

    def step(s, k):
        m = F.floor(k / 2).cast("double")
        a, b, x = s["a"], s["b"], s["x"]
        at = a + 2 * m
        term = F.when(k % 2 == 0, m * (b - m) * x / ((at - 1) * at)).otherwise(
            -(a + m) * (a + b + m) * x / (at * (at + 1))
        )
        d = F.lit(1.0) / (1 + term * s["d"] + F.lit(_TINY))
        c = 1 + term / s["c"] + F.lit(_TINY)
        return F.struct(
            a.alias("a"), b.alias("b"), x.alias("x"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h")
        )

    one = F.lit(1.0)
    start = F.struct(
        a.alias("a"), b.alias("b"), x.alias("x"), F.lit(1e300).alias("c"), one.alias("d"), one.alias("h")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["h"])


def ln_gamma_step(a: Column, b: Column) -> Column:
    """ln Gamma(a + b) - ln Gamma(a).

    For large a both terms are huge and nearly equal; there the difference of their Stirling series is taken, in which
    the large parts cancel by hand.
    """
    s = a + b
    large = (a - 0.5) * F.log1p(b / a) + b * F.log(s) - b - b / (12 * a * s) + (1 / F.pow(a, 3) - 1 / F.pow(s, 3)) / 360
    return F.when(a > 1e4, large).otherwise(ln_gamma(s) - ln_gamma(a))


def beta_inc(a: Column, b: Column, x: Column, y: Column | None = None) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b >= 0.5; ``y`` is 1 - x where that is known better."""
    y = 1 - x if y is None else y
    a, b, x, y = (c.cast("double") for c in (a, b, x, y))
    log_x = F.when(x < 0.5, F.log(F.greatest(x, F.lit(_TINY)))).otherwise(F.log1p(-y))
    log_y = F.when(y < 0.5, F.log(F.greatest(y, F.lit(_TINY)))).otherwise(F.log1p(-x))
    less, more = F.least(a, b), F.greatest(a, b)
    front = F.exp(ln_gamma_step(more, less) - ln_gamma(less) + a * log_x + b * log_y)
    low = x < (a + 1) / (a + b + 2)
    fraction = _beta_fraction(
        F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(y)
    )
    inner = F.when(low, front * fraction / a).otherwise(1 - front * fraction / b)
    return F.when(x <= 0, F.lit(0.0)).when(y <= 0, F.lit(1.0)).otherwise(inner)


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided tail probability of the standard normal: erfc(|z| / sqrt(2)).

    A series of 36 terms below x = 2, a continued fraction of 40 levels from there on; both are good to 1e-13.
    """
    x = F.abs(z.cast("double")) / math.sqrt(2)
    near, far = F.least(x, F.lit(2.0)), F.greatest(x, F.lit(2.0))
    series = F.lit(1.0)
    for k in range(36, 0, -1):
        series = 1 + series * (2 * near * near) / (2 * k + 1)
    level = far
    for k in range(40, 0, -1):
        level = far + F.lit(k / 2) / level
    inner = 1 - near * F.exp(-near * near) * series * (2 / math.sqrt(math.pi))
    return F.when(x < 2, inner).otherwise(F.exp(-far * far) / level / math.sqrt(math.pi))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided tail probability of Student's t with fractional degrees of freedom.

    NULL when t or df is NULL or df is not positive. Beyond a million degrees of freedom, where the continued fraction
    loses digits, t is replaced by the value with the same normal deviate at a million.
    """
    cap = 1e6
    deviate = (df - 0.5) * F.log1p(t * t / df)
    square = F.when(df > cap, cap * F.expm1(deviate / (cap - 0.5))).otherwise(t * t)
    df = F.when(df > cap, F.lit(cap)).otherwise(df)
    p = beta_inc(df / 2, F.lit(0.5), df / (df + square), square / (df + square))
    return F.when(t.isNotNull() & (df > 0), F.when(t == 0, F.lit(1.0)).otherwise(p))
