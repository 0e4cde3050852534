"""Statistics over feature tables: correlations, contingency tests, signals.

Correlations of all columns come from one Gram matrix (``pyspark.ml.stat``), tests on
categories from one long contingency table; no data reaches the driver, only the
matrix, whose size is that of the column list squared.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_p, correlation_p


def gram_correlations(df: DataFrame, cols: Sequence[str]) -> list[list[float | None]]:
    """Pearson correlation matrix of ``cols`` (no NULLs), None where a column is constant."""
    cols = list(cols)
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    v = VectorAssembler(inputCols=cols, outputCol="_v").transform(numbers).select("_v")
    m = Correlation.corr(v, "_v").first()[0].toArray().tolist()
    return [[None if math.isnan(x) else max(-1.0, min(1.0, x)) for x in row] for row in m]


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Pearson r of each column with the target, |r|, n, t statistic and two-sided p."""
    spark = df.sparkSession
    r = gram_correlations(df, [*cols, target])[-1]
    long = spark.createDataFrame(list(zip(cols, r)), "feature string, pearson_r double")
    n = df.agg(F.count(F.lit(1)).alias("n"))
    t = F.col("pearson_r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("pearson_r") * F.col("pearson_r")))
    return long.crossJoin(F.broadcast(n)).select("feature", "pearson_r", F.abs("pearson_r").alias("abs_r"), "n", t.alias("t_stat"),
                                                 correlation_p(F.col("pearson_r"), F.col("n")).alias("p_value"))


def pairwise_corr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Upper triangle of the correlation matrix in long form."""
    m = gram_correlations(df, cols)
    rows = [(a, b, m[i][j]) for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def contingency(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Counts ``o`` by ``feature``, value ``f`` and target ``y``, of all columns in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("f")) for c in cols])
    return (df.select(F.explode(cells).alias("x"), F.col(target).alias("y")).groupBy("x.feature", "x.f", "y")
            .agg(F.count(F.lit(1)).alias("o")))


def _chi2(o, e, dof):
    """One cell's share; Yates' correction (observed moved toward expected by 0.5 at most) at one degree of freedom."""
    moved = o + F.signum(e - o) * F.least(F.lit(0.5), F.abs(e - o))
    adj = F.when(dof == 1, moved).otherwise(o)
    return (adj - e) * (adj - e) / e


def chi2_tests(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Chi-square statistic, degrees of freedom and p of every feature x target table."""
    ct = contingency(df, cols, target)
    rows = ct.groupBy("feature", "f").agg(F.sum("o").alias("rf"))
    columns = ct.groupBy("feature", "y").agg(F.sum("o").alias("cy"))
    tot = ct.groupBy("feature").agg(F.sum("o").alias("n"), F.count_distinct("f").alias("kf"), F.count_distinct("y").alias("ky"))
    # every f x y cell of a feature, zero when absent
    grid = rows.join(columns, "feature").join(tot, "feature").join(ct, ["feature", "f", "y"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    dof = (F.col("kf") - 1) * (F.col("ky") - 1)
    e = F.col("rf") * F.col("cy") / F.col("n")
    got = grid.groupBy("feature").agg(F.sum(_chi2(F.col("o"), e, dof)).alias("chi2"), F.first(dof).cast("bigint").alias("dof"))
    return got.withColumn("p_value", chi2_p(F.col("chi2"), F.col("dof")))


def binary_signals(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """For the columns that hold 0 and 1 only, and both: point-biserial r and its p, the
    2 x 2 chi-square p, the target's rate at 1 and 0, lift, and STRONG for |r| > 0.05 with p < 0.05."""
    ct = contingency(df, cols, target)
    cell = lambda f, y: F.coalesce(F.sum(F.when((F.col("f") == f) & (F.col("y") == y), F.col("o"))), F.lit(0)).cast("double").alias(f"n{f}{y}")
    other = F.count_if(F.col("f").isNull() | ~F.col("f").isin(0.0, 1.0)).alias("other")
    t = ct.groupBy("feature").agg(other, *[cell(f, y) for f in (0, 1) for y in (0, 1)])
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    t = t.select("feature", n00, n01, n10, n11, (n00 + n01).alias("f0"), (n10 + n11).alias("f1"), (n00 + n10).alias("y0"), (n01 + n11).alias("y1"),
                 (n00 + n01 + n10 + n11).alias("n")).where("other = 0 and f0 > 0 and f1 > 0 and y0 > 0 and y1 > 0")
    r = (n11 * n00 - n10 * n01) / (F.sqrt(F.col("f0")) * F.sqrt(F.col("f1")) * F.sqrt(F.col("y0")) * F.sqrt(F.col("y1")))
    one = F.lit(1)
    chi = sum((_chi2(o, F.col(f) * F.col(y) / F.col("n"), one) for o, f, y in ((n00, "f0", "y0"), (n01, "f0", "y1"), (n10, "f1", "y0"), (n11, "f1", "y1"))), F.lit(0.0))
    t = t.select("feature", r.alias("pb_r"), "n", chi.alias("chi2"), (n11 / F.col("f1")).alias("rate_when_1"), (n01 / F.col("f0")).alias("rate_when_0"))
    t = t.select("feature", "pb_r", correlation_p(F.col("pb_r"), F.col("n")).alias("pb_p"), chi2_p(F.col("chi2"), F.lit(1.0)).alias("chi2_p"),
                 "rate_when_1", "rate_when_0", (F.col("rate_when_1") / F.greatest(F.col("rate_when_0"), F.lit(0.001))).alias("lift"))
    return t.withColumn("signal", F.when((F.abs("pb_r") > 0.05) & (F.col("chi2_p") < 0.05), "STRONG").otherwise("WEAK"))
