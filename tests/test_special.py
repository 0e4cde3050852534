"""Tails of Student's t and chi-square against closed forms."""

import math
import random

from pyspark.sql import functions as F

from riskfeatures.functions.special import chi2_p, correlation_p, student_p


def student_exact(t, dof):
    """Two-sided p by the finite sums for integer degrees of freedom."""
    theta = math.atan(t / math.sqrt(dof))
    if dof == 1:
        return 1 - 2 * theta / math.pi
    term = total = math.cos(theta) if dof % 2 else 1.0
    for k in range(2 if dof % 2 else 1, dof - 2, 2):
        term *= k / (k + 1) * math.cos(theta) ** 2
        total += term
    return 1 - (2 / math.pi * (theta + math.sin(theta) * total) if dof % 2 else math.sin(theta) * total)


def chi2_exact(x, dof):
    if dof % 2 == 0:
        return math.exp(-x / 2) * math.fsum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))
    p = math.erfc(math.sqrt(x / 2))
    return p + math.exp(-x / 2) * math.fsum((x / 2) ** (k - 0.5) / math.gamma(k + 0.5) for k in range(1, (dof + 1) // 2))


def test_student_p(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(0, 8), float(d)) for d in (1, 2, 3, 4, 5, 9, 30, 101, 500, 1999, 2000, 2001, 2500, 15000, 100001) for _ in range(6)]
    got = spark.createDataFrame(rows, "t double, d double").select("t", "d", student_p(F.col("t"), F.col("d")).alias("p"), student_p(-F.col("t"), F.col("d")).alias("q"))
    for r in got.collect():
        assert abs(r.p - student_exact(r.t, int(r.d))) < 1e-9 and r.p == r.q, r


def test_chi2_p(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.01, 1, 5, 60]) * rng.random(), float(d)) for d in (1, 2, 3, 4, 7, 12, 40) for _ in range(8)] + [(3000.0, 1.0), (0.0, 3.0), (5.0, 0.0)]
    got = spark.createDataFrame(rows, "x double, d double").select("x", "d", chi2_p(F.col("x"), F.col("d")).alias("p"))
    for r in got.collect():
        want = 1.0 if r.d == 0 or r.x == 0 else chi2_exact(r.x, int(r.d))
        assert abs(r.p - want) < 1e-9, r


def test_correlation_p_edges(spark):
    rows = [(1.0, 10), (-1.0, 10), (0.0, 10), (0.5, 11), (None, 11)]
    got = [r.p for r in spark.createDataFrame(rows, "r double, n long").select(correlation_p(F.col("r"), F.col("n")).alias("p")).collect()]
    assert got[:3] == [0.0, 0.0, 1.0] and abs(got[3] - student_exact(0.5 * math.sqrt(9 / 0.75), 9)) < 1e-9 and got[4] is None
