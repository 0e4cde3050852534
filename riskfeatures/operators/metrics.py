"""Rank and threshold metrics for binary scores, computed distributed.

Scores are first grouped (one row per distinct score, partial aggregate), then
cumulative TP/FP over descending scores come from ``ranges.scan``: range partitions
with sampled splitters, so scores bunched in a narrow range still spread over all
tasks.  All metrics take ``by`` columns: many folds, models or draws share one pass.

Conventions follow scikit-learn: step-wise average precision (ties grouped),
ROC-AUC with ties counted 1/2, ROC points with collinear points dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import sql_round
from ..session import stored_table
from .ranges import scan


def score_groups(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("cnt"))


def cumulative(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score (descending) of every ``by`` group: pos, neg, tps, fps (cumulative
    incl. this score), totals P and N, a dense rank ``idx`` (1 = highest score) and the
    range partition ``part``."""
    g = stored_table(score_groups(df, label, score, by).withColumn("neg", F.col("cnt") - F.col("pos")).drop("cnt"), "score-groups")
    cum = scan(g, by, [F.col("score").desc()], {"tps": ("sum", F.col("pos")), "fps": ("sum", F.col("neg")), "idx": ("sum", F.lit(1).cast("bigint"))},
               name="scores")
    totals = cum.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.max("tps").alias("P"), F.max("fps").alias("N"), F.max("idx").alias("n_scores"))
    # one row per group: folds and models, not data
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.lit(True))
    return cum.join(F.broadcast(totals), same).drop(*[f"_{c}" for c in by])


def rank_metrics() -> dict[str, Column]:
    """Aggregates of ``cumulative`` rows: step-wise average precision, the sum over distinct
    thresholds of (R_k - R_{k-1}) * P_k, and Mann-Whitney AUC with ties = 1/2."""
    ap = F.sum(F.col("pos") / F.col("P") * F.col("tps") / (F.col("tps") + F.col("fps")))
    auc = F.sum(F.col("pos") * (F.col("N") - F.col("fps") + 0.5 * F.col("neg"))) / (F.first("P") * F.first("N"))
    return {"pr_auc": ap, "roc_auc": auc}


def average_precision(cum: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cum.groupBy(*by).agg(rank_metrics()["pr_auc"].alias("average_precision"))


def roc_auc(cum: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return cum.groupBy(*by).agg(rank_metrics()["roc_auc"].alias("roc_auc"))


def roc_curve(cum: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """ROC points (fpr, tpr, threshold) with the leading (0, 0, inf) point.  A point's
    neighbours come from lag and lead inside its range partition; the partitions' border
    rows (two each, broadcast) stand in at their ends."""
    pts = cum.select("idx", "score", "tps", "fps", "P", "N", "n_scores", "part")
    if drop_intermediate:
        point = F.struct("tps", "fps")
        ends = pts.groupBy("part").agg(F.min_by(point, "idx").alias("_first"), F.max_by(point, "idx").alias("_last"))
        order = Window.orderBy("part")  # a row per range partition
        halo = ends.select("part", F.lag("_last").over(order).alias("_before"), F.lead("_first").over(order).alias("_after"))
        inside = Window.partitionBy("part").orderBy("idx")
        pts = pts.select("*", F.lag(point).over(inside).alias("_p"), F.lead(point).over(inside).alias("_n")).join(F.broadcast(halo), "part")
        p, n = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
        keep = ((F.col("idx") == 1) | (F.col("idx") == F.col("n_scores")) |
                (n["fps"] - 2 * F.col("fps") + p["fps"] != 0) | (n["tps"] - 2 * F.col("tps") + p["tps"] != 0))
        pts = pts.filter(keep)
    body = pts.select((F.col("fps") / F.col("N")).alias("fpr"), (F.col("tps") / F.col("P")).alias("tpr"),
                      F.col("score").alias("threshold"))
    first = cum.sparkSession.range(1).select(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return first.unionByName(body)


def pr_curve(cum: DataFrame) -> DataFrame:
    """precision / recall at each distinct threshold plus the (1, 0) end point."""
    body = cum.select((F.col("tps") / (F.col("tps") + F.col("fps"))).alias("precision"),
                      F.when(F.col("P") > 0, F.col("tps") / F.col("P")).otherwise(1.0).alias("recall"),
                      F.col("score").alias("threshold"))
    end = cum.sparkSession.range(1).select(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                                           F.lit(None).cast("double").alias("threshold"))
    return body.unionByName(end)


def confusion_counts(df: DataFrame, threshold: float, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    pred = (F.col(score) >= threshold).cast("int")
    y = F.col(label).cast("int")
    return df.groupBy(*by).agg(F.count_if((y == 0) & (pred == 0)).alias("tn"), F.count_if((y == 0) & (pred == 1)).alias("fp"),
                               F.count_if((y == 1) & (pred == 0)).alias("fn"), F.count_if((y == 1) & (pred == 1)).alias("tp"))


def threshold_metrics(df: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, F1, accuracy at a threshold (sklearn zero_division=0)."""
    c = confusion_counts(df, threshold, label, score, by)
    p = F.coalesce(F.try_divide(F.col("tp") * 1.0, F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp") * 1.0, F.col("tp") + F.col("fn")), F.lit(0.0))
    return c.select(*by, F.lit(float(threshold)).alias("threshold"), "tn", "fp", "fn", "tp",
                    sql_round(p, 4).alias("precision"), sql_round(r, 4).alias("recall"),
                    sql_round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 4).alias("f1"),
                    sql_round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 4)
                    .alias("accuracy"))


def ranked_keys(df: DataFrame, part: str, key: str, ranks: dict[str, str]) -> list[tuple]:
    """The hexadecimal ``key`` at certain ranks of every ``part``, by radix selection:
    ``ranks`` are SQL expressions of the part's row count ``n`` (0: none).  A pass counts three
    more digits of the rows that still share a wanted prefix; the digits are chosen in
    Spark, and one row per (part, rank) reaches the driver.  ``(part, rank's name, key)``;
    the key is None at rank 0."""
    names = list(ranks)
    n = df.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    wanted = n.select(F.col(part).alias("_p"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.expr(e).cast("bigint").alias("rank")) for c, e in ranks.items()]))
                      .alias("w")).select("_p", "w.name", "w.rank").collect()
    kind = df.schema[part].dataType
    todo, found = [(p, c, "", r) for p, c, r in wanted if r > 0], [(p, c, None) for p, c, r in wanted if r <= 0]
    for at in range(1, 33, 3):
        if not todo:
            break
        state = df.sparkSession.createDataFrame(todo, f"_p {kind.simpleString()}, _name string, _prefix string, _rank bigint")
        near = df.join(F.broadcast(state), F.col(part).eqNullSafe(F.col("_p")) & F.col(key).startswith(F.col("_prefix")))
        digits = near.groupBy("_p", "_name", "_prefix", "_rank", F.substring(key, at, 3).alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_key"))
        upto = F.sum("_n").over(Window.partitionBy("_p", "_name").orderBy("_d"))  # at most 4096 rows
        hit = digits.withColumn("_upto", upto).where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))).collect()
        found += [(r["_p"], r["_name"], r["_key"]) for r in hit if r["_n"] == 1 or at == 31]
        todo = [(r["_p"], r["_name"], r["_prefix"] + r["_d"], r["_rank"] - (r["_upto"] - r["_n"])) for r in hit if r["_n"] > 1 and at < 31]
    assert len(found) == len(wanted) and all(c in names for _, c, _ in found)
    return found


def md5_order(id_col: str, seed: int = 42):
    """Portable pseudo-random order key: md5('seed|id') (same in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def stratified_split(df: DataFrame, id_col: str, label: str, seed: int = 42,
                     fractions=(70, 15, 15)) -> DataFrame:
    """Exact per-class 70/15/15 split in md5 order: per class with n rows the
    first (70n+50) DIV 100 go to train, the next (15n+50) DIV 100 to val.  The two cut
    keys of a class are selected, then every row is compared with them."""
    keyed = df.withColumn("_h", md5_order(id_col, seed))
    train, val = fractions[0], fractions[1]
    cuts = ranked_keys(keyed.select(label, "_h"), label, "_h", {
        "train": f"(n * {train} + 50) DIV 100", "val": f"(n * {train} + 50) DIV 100 + (n * {val} + 50) DIV 100"})
    by_class: dict = {}
    for p, name, k in cuts:
        by_class.setdefault(p, {})[name] = k or ""
    kind = df.schema[label].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(p, c["train"], c["val"]) for p, c in by_class.items()], f"_p {kind}, _train string, _val string")
    return (keyed.join(F.broadcast(table), F.col(label) == F.col("_p"))
            .withColumn("split", F.when(F.col("_h") <= F.col("_train"), "train").when(F.col("_h") <= F.col("_val"), "val").otherwise("test"))
            .drop("_h", "_p", "_train", "_val"))


def kfold(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Stratified fold id = (rank within class - 1) mod k in md5(seed|id) order."""
    r = scan(df.withColumn("_h", md5_order(id_col, seed)), [label], ["_h"], {"_rk": ("sum", F.lit(1).cast("bigint"))}, name="folds")
    return r.withColumn("fold", ((F.col("_rk") - 1) % k).cast("int")).drop("_h", "_rk", "part")
