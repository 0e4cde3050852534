"""Encoders and imputers as DataFrame transforms (no driver round trips).

Group statistics (target means, category codes, fill means) are small
aggregates joined back; fixed-size ones (1 row) are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .scalar import sql_round


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str) -> DataFrame:
    """pandas get_dummies for a known vocabulary (sorted): prefix_value int columns."""
    out = df
    for v in sorted(values):
        out = out.withColumn(f"{prefix}_{v}", (F.col(col) == v).cast("int"))
    return out


def target_encode(df: DataFrame, group: str, target: str, out: str,
                  unknown: str | float | None = "global_mean") -> DataFrame:
    """Group mean of the target joined back; unknown groups -> global mean (or a value)."""
    g = df.groupBy(group).agg(F.avg(target).alias("_te"))
    j = df.join(g, df[group].eqNullSafe(g[group]), "left").drop(g[group])
    if unknown == "global_mean":
        gm = df.agg(F.avg(target).alias("_gm"))
        j = j.crossJoin(F.broadcast(gm)).withColumn(out, F.coalesce("_te", "_gm")).drop("_gm")
    elif unknown is not None:
        j = j.withColumn(out, F.coalesce(F.col("_te"), F.lit(unknown)))
    else:
        j = j.withColumn(out, F.col("_te"))
    return j.drop("_te")


def target_encode_oof(df: DataFrame, group: str, target: str, fold: str, out: str) -> DataFrame:
    """Out-of-fold group mean: (group total - fold part) / (group n - fold n);
    falls back to the out-of-fold global mean when the group has no other rows."""
    gf = df.groupBy(group, fold).agg(F.sum(target).alias("_sf"), F.count(F.lit(1)).alias("_nf"))
    w = Window.partitionBy(group)   # over (group, fold) aggregates: rows = folds per group
    g = gf.select(group, fold, "_sf", "_nf", F.sum("_sf").over(w).alias("_sg"), F.sum("_nf").over(w).alias("_ng"))
    fo = df.groupBy(fold).agg(F.sum(target).alias("_sfo"), F.count(F.lit(1)).alias("_nfo"))
    tot = df.agg(F.sum(target).alias("_st"), F.count(F.lit(1)).alias("_nt"))
    stats_ = (g.join(F.broadcast(fo), fold).crossJoin(F.broadcast(tot))
              .select(group, fold,
                      F.coalesce(F.try_divide((F.col("_sg") - F.col("_sf")) * 1.0, F.col("_ng") - F.col("_nf")),
                                 (F.col("_st") - F.col("_sfo")) / (F.col("_nt") - F.col("_nfo"))).alias(out)))
    return df.join(stats_, [df[group].eqNullSafe(stats_[group]), df[fold] == stats_[fold]], "left") \
        .drop(stats_[group]).drop(stats_[fold])


def category_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """pandas .cat.codes: alphabetical dense code over distinct values, NULL -> -1.
    The distinct values are numbered across range partitions."""
    from ..operators.windows import global_row_number
    d = df.select(F.col(col).alias("_value")).where("_value is not null").distinct()
    codes = global_row_number(d, ["_value"], "_code")
    return (df.join(codes, F.col(col) == F.col("_value"), "left")
            .withColumn(out, F.coalesce(F.col("_code") - 1, F.lit(-1)).cast("int")).drop("_value", "_code"))


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def fill_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL -> column mean from a 1-row aggregate (broadcast cross join, not collect)."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(means))
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")))
    return out.drop(*[f"_m_{c}" for c in cols])


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def qcut(df: DataFrame, col: str, q: int, out: str = "bucket", clip: tuple[float, float] | None = None) -> DataFrame:
    """pandas qcut(duplicates='drop') with optional 2/98 % winsorising first:
    right-closed buckets, the lowest edge included; returns bucket index and edges."""
    x = F.col(col).cast("double")
    src = df
    if clip:
        lo, hi = (F.lit(v).cast("double") for v in exact_quantiles(df, [col], clip)[col])
        src = df.withColumn("_x", F.when(x.isNull(), x).otherwise(F.least(F.greatest(x, lo), hi)))
    else:
        src = df.withColumn("_x", x)
    probs = [i / q for i in range(q + 1)]
    edges = exact_quantiles(src, ["_x"], probs)["_x"]
    j = src.withColumn("_e", F.array_distinct(F.array(*[sql_round(F.lit(v).cast("double"), 9) for v in edges])))
    idx = F.greatest(F.size(F.filter("_e", lambda v: v < sql_round(F.col("_x"), 9))) - 1, F.lit(0))
    return (j.withColumn(out, F.when(F.col("_x").isNotNull(), idx))
            .withColumn("bucket_lo", F.element_at("_e", F.col(out) + 1))
            .withColumn("bucket_hi", F.element_at("_e", F.col(out) + 2)))
