"""Aggregation helpers: profiles, describe, histograms, string aggregation.

Wide profiles are computed in ONE aggregate pass over the input (one partial
aggregate per column per task) and turned long with ``stack`` afterwards, so
the number of scans does not grow with the number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles


def _stack(one: DataFrame, names: Sequence[str], fields: Sequence[str], key: str = "feature") -> DataFrame:
    """One-row frame with columns ``{name}|{field}`` -> long (key, fields...)."""
    parts = ", ".join(f"'{n}', " + ", ".join(f"`{n}|{f}`" for f in fields) for n in names)
    return one.select(F.expr(f"stack({len(names)}, {parts})").alias(key, *fields))


def describe(df: DataFrame, cols: Sequence[str], percentiles=(0.25, 0.5, 0.75)) -> DataFrame:
    """pandas ``describe``: count, mean, sample std, min, exact percentiles, max."""
    aggs = []
    pn = [f"p{int(round(p * 100))}" for p in percentiles]
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}|count"), F.avg(x).alias(f"{c}|mean"),
                 F.stddev_samp(x).alias(f"{c}|std"), F.min(x).alias(f"{c}|min"),
                 F.max(x).alias(f"{c}|max")]
    q = exact_quantiles(df, cols, percentiles)
    one = df.agg(*aggs)
    one = one.select("*", *[F.lit(q[c][i]).cast("double").alias(f"{c}|{p}") for c in cols for i, p in enumerate(pn)])
    fields = ["count", "mean", "std", "min", *pn, "max"]
    return _stack(one, cols, fields)


def column_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, non-null count, null %, distinct count, dtype.  Values go long as
    (column, value), equal ones are counted together, then counted per column: one scan
    and one shuffle of distinct pairs, whatever the number of columns."""
    cols = list(cols or df.columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.col(c).cast("string").alias("v"))
                      for c in cols])
    pairs = df.select(F.explode(cells).alias("x")).groupBy("x.column", "x.dtype", "x.v").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("column", "dtype").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"), F.count("v").alias("n_distinct"))
    return per.select("column", "dtype", "n_rows", "non_null", ((F.col("n_rows") - F.col("non_null")) * 100.0 / F.col("n_rows")).alias("null_pct"),
                      "n_distinct", (F.col("n_distinct") == 1).alias("is_constant"), (F.col("n_distinct") == 2).alias("is_binary"))


def corrected_skew(x: Column) -> Column:
    """Sample-bias-corrected skewness (pandas ``.skew()``); Spark's is population."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def equal_width_hist(df: DataFrame, col: str, bins: int) -> DataFrame:
    """numpy/matplotlib equal-width histogram: bins over [min, max], last bin closed."""
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    idx = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("_lo")) / w), F.lit(bins - 1)))
    return (df.filter(x.isNotNull()).crossJoin(F.broadcast(mm))
            .groupBy(idx.cast("int").alias("bin"), "_lo", "_hi")
            .agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_hi"),
                    "count"))


def string_distribution(df: DataFrame, key: str, fmt: str, by_count_desc: bool = True,
                        sep: str = ", ") -> DataFrame:
    """'k1: n1, k2: n2, ...' over a groupBy count (counts desc, key asc on ties)."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    item = F.format_string(fmt, F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("_n"))
    srt = F.struct((-F.col("_n")).alias("a"), F.col(key).alias("b"), item.alias("s")) if by_count_desc \
        else F.struct(F.col(key).alias("a"), item.alias("s"))
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(srt)), lambda s: s["s"]), sep)
                 .alias("detail"))
