"""Special functions as column expressions: tails of Student's t and chi-square.

Regularised incomplete beta and gamma functions by their continued fractions and
series over a fixed number of steps (``aggregate`` over a literal sequence), so p-values
are plain columns: no Python workers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 300
FAR = 2000.0   # degrees of freedom from which Student's t is expanded about the normal

# Lanczos coefficients (g = 7).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 0.5."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        series = series + c / (x + i)
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(t) - t + F.log(series)


def _steps():
    return F.sequence(F.lit(1), F.lit(STEPS))


def _not_zero(x: Column) -> Column:
    return F.when(F.abs(x) < 1e-300, F.lit(1e-300)).otherwise(x)


def _state(c: Column, d: Column, h: Column) -> Column:
    return F.struct(c.cast("double").alias("c"), d.cast("double").alias("d"), h.cast("double").alias("h"))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    d0 = 1 / _not_zero(1 - (a + b) * x / (a + 1))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        d1 = 1 / _not_zero(1 + even * s["d"])
        c1 = _not_zero(1 + even / s["c"])
        d2 = 1 / _not_zero(1 + odd * d1)
        c2 = _not_zero(1 + odd / c1)
        return _state(c2, d2, s["h"] * d1 * c1 * d2 * c2)
    return F.aggregate(_steps(), _state(F.lit(1.0), d0, d0), step)["h"]


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b), a and b at least 0.5."""
    front = F.exp(a * F.log(x) + b * F.log(1 - x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b))
    inside = F.when(x < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inside)


def gamma_upper(a: Column, z: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, z), a at least 0.5."""
    front = F.exp(a * F.log(z) - z - log_gamma(a))
    series = F.aggregate(_steps(), F.struct((1 / a).alias("term"), (1 / a).alias("total")), lambda s, k: F.struct(
        (s["term"] * z / (a + k)).alias("term"), (s["total"] + s["term"] * z / (a + k)).alias("total")))["total"]
    d0 = 1 / _not_zero(z + 1 - a)

    def step(s: Column, k: Column) -> Column:
        an, bn = -k * (k - a), z + 1 - a + 2 * k
        d = 1 / _not_zero(an * s["d"] + bn)
        c = _not_zero(bn + an / s["c"])
        return _state(c, d, s["h"] * d * c)
    tail = F.aggregate(_steps(), _state(F.lit(1e300), d0, d0), step)["h"]
    return F.when(z <= 0, F.lit(1.0)).when(z < a + 1, 1 - front * series).otherwise(front * tail)


def chi2_p(x: Column, dof: Column) -> Column:
    """P(X >= x) of chi-square; 1 without degrees of freedom."""
    return F.when(dof <= 0, F.lit(1.0)).otherwise(gamma_upper(dof / 2.0, x / 2.0))


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided p of Student's t.  Beyond ``FAR`` degrees of freedom, where the fraction
    would need ever more steps, Fisher's expansion about the normal (error below 1e-10)."""
    s = t * t
    near = beta_inc(dof / 2.0, F.lit(0.5), dof / (dof + s))
    u = F.abs(t)
    density = F.exp(-s / 2) / math.sqrt(2 * math.pi)
    first = (s + 1) * u / 4
    second = ((3 * s - 7) * s - 5) * s - 3
    third = ((((s - 11) * s + 14) * s + 6) * s - 3) * s - 15
    expanded = gamma_upper(F.lit(0.5), s / 2) + 2 * density * (first / dof + u * second / (96 * dof * dof) + u * third / (384 * dof * dof * dof))
    return F.when(s == 0, F.lit(1.0)).when(dof <= FAR, near).otherwise(expanded)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of Pearson's r (also point-biserial) over ``n`` rows, by Student's t."""
    t = F.abs(r) * F.sqrt(F.try_divide(n - 2.0, 1 - r * r))
    return F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(student_p(t, n - 2.0))
