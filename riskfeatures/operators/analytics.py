"""Cohort / segment analytics over a feature table (one query each; group-bys
are partial aggregates, dimensions with fixed order are tiny literal frames)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEPT_RISK_BINS, DEPT_RISK_LABELS, REVISION_BUCKETS
from ..functions.scalar import bin_index, right_closed_bin


def rate_by(df: DataFrame, keys: Sequence, label: str = "calculated_overdue",
            count_name: str = "num_tasks") -> DataFrame:
    """count / mean / percent of the label per segment."""
    return df.groupBy(*keys).agg(
        F.count(F.col(label)).alias(count_name),
        F.avg(F.col(label)).alias("overdue_rate"),
        (F.avg(F.col(label)) * 100).alias("overdue_rate_pct"))


def ordered_dimension(spark, name: str, values: Sequence, order_col: str = "sort_key") -> DataFrame:
    """Literal (value, sort_key) frame for reindexing onto a fixed category order."""
    d = spark.createDataFrame([(v, i) for i, v in enumerate(values)], [name, order_col])
    return d.withColumn(order_col, F.col(order_col).cast("int"))


def dept_risk_tiers(df: DataFrame, edges=DEPT_RISK_BINS, labels=DEPT_RISK_LABELS,
                    include_lowest: bool = False) -> DataFrame:
    """Bin the historical department rate into tiers, actual rate per tier (NULL tier dropped)."""
    x = "dept_past_overdue_rate"
    t = df.select(right_closed_bin(x, edges, labels, include_lowest).alias("risk_tier"),
                  bin_index(x, edges, include_lowest).alias("tier_order"),
                  "calculated_overdue", x)
    return (t.filter(F.col("risk_tier").isNotNull())
            .groupBy("risk_tier", "tier_order")
            .agg(F.count("calculated_overdue").alias("num_tasks"),
                 (F.avg("calculated_overdue") * 100).alias("actual_overdue_pct"),
                 F.avg(x).alias("dept_hist_rate_mean")))


def two_segment_rate(df: DataFrame, flag: str, names: Sequence[str]) -> DataFrame:
    """Rate for flag = 0 / 1 with both segments always present (default 0)."""
    spark = df.sparkSession
    dim = (spark.createDataFrame([(i, n) for i, n in enumerate(names)], [flag, "segment"])
           .withColumn(flag, F.col(flag).cast("int")))
    g = df.groupBy(flag).agg((F.avg("calculated_overdue") * 100).alias("_r"),
                             F.count(F.lit(1)).alias("_n"))
    return (dim.join(g, flag, "left")
            .select(flag, "segment", F.coalesce("_r", F.lit(0.0)).alias("overdue_rate_pct"),
                    F.coalesce("_n", F.lit(0)).alias("num_tasks")))


def revision_bucket(c: Column) -> Column:
    return (F.when(c <= 0, "0").when(c == 1, "1").when(c == 2, "2").otherwise("3+"))


def revision_spiral(df: DataFrame, col: str = "num_revisions") -> DataFrame:
    dim = ordered_dimension(df.sparkSession, "revisions", REVISION_BUCKETS)
    g = df.groupBy(revision_bucket(F.col(col)).alias("revisions")).agg(
        F.count("calculated_overdue").alias("num_tasks"),
        F.avg("calculated_overdue").alias("overdue_rate"))
    return (dim.join(g, "revisions", "left")
            .select("revisions", "sort_key", "num_tasks", "overdue_rate",
                    (F.col("overdue_rate") * 100).alias("overdue_rate_pct")))


def long_segments(df: DataFrame, dims: dict[str, Column], label: str = "calculated_overdue") -> DataFrame:
    """Several one-dimensional segmentations in one scan + one shuffle:
    each row is expanded to (dimension, value) pairs and grouped once."""
    arr = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value"))
                    for n, c in dims.items()])
    e = df.select(F.explode(arr).alias("_d"), F.col(label))
    return rate_by(e, [F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value")],
                   label)


def lift_table(df: DataFrame, flags: dict[str, str], label: str = "calculated_overdue") -> DataFrame:
    """Present %, rate when present / absent and lift for several 0/1 flags (one pass)."""
    aggs = []
    for name, c in flags.items():
        aggs += [F.avg(F.col(c).cast("double")).alias(f"{name}|p"),
                 F.avg(F.when(F.col(c) == 1, F.col(label))).alias(f"{name}|r1"),
                 F.avg(F.when(F.col(c) == 0, F.col(label))).alias(f"{name}|r0")]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}|p`, `{n}|r1`, `{n}|r0`" for n in flags)
    long = one.select(F.expr(f"stack({len(flags)}, {stack})").alias("challenge_type", "p", "r1", "r0"))
    return long.select(
        "challenge_type", (F.col("p") * 100).alias("pct_tasks_affected"),
        (F.col("r1") * 100).alias("rate_present_pct"), (F.col("r0") * 100).alias("rate_absent_pct"),
        F.when(F.col("r0") > 0, F.col("r1") / F.col("r0")).otherwise(0.0).alias("lift"))
