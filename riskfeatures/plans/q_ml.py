"""Registered queries: splits, folds and model metrics (SQL-checkable)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import GAUGE_BANDS, RISK_BADGE
from ..operators import metrics as M
from ..operators.windows import global_row_number
from ..sources.roles import roles
from .catalog import register
from .oracle_wide import feat_with
from .q_analytics import _feat

_CUM_SQL = """g AS (SELECT score, CAST(sum(label) AS BIGINT) AS pos, count(*) AS cnt FROM {src} GROUP BY 1),
c AS (SELECT score, pos, cnt - pos AS neg,
  CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tps, CAST(sum(cnt - pos) OVER (ORDER BY score DESC) AS BIGINT) AS fps,
  CAST(sum(pos) OVER () AS BIGINT) AS P, CAST(sum(cnt - pos) OVER () AS BIGINT) AS N,
  row_number() OVER (ORDER BY score DESC) AS idx FROM g)"""


def _scored(spark, sf):
    return roles(spark, sf).scored


@register("ml_average_precision", round_cols=("average_precision",),
          oracle="WITH " + _CUM_SQL.format(src="scored") + "\nSELECT sum(pos / P * tps / (tps + fps)) AS average_precision FROM c")
def ml_average_precision(spark, sf):
    """Step-wise average precision with tied scores grouped."""
    return M.average_precision(M.cumulative(_scored(spark, sf)))


@register("ml_roc_auc", round_cols=("roc_auc",),
          oracle="WITH " + _CUM_SQL.format(src="scored") + "\nSELECT sum(pos * (N - fps + 0.5 * neg)) / (max(P) * max(N)) AS roc_auc FROM c")
def ml_roc_auc(spark, sf):
    """ROC-AUC by rank sum over grouped scores, ties = 1/2."""
    return M.roc_auc(M.cumulative(_scored(spark, sf)))


def _thr_sql(t):
    return f"""SELECT CAST({t} AS DOUBLE) AS threshold, tn, fp, fn, tp,
  round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 4) AS recall,
  round(coalesce(2 * (coalesce(tp * 1.0 / nullif(tp + fp, 0), 0)) * (coalesce(tp * 1.0 / nullif(tp + fn, 0), 0))
    / nullif(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0) + coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 0), 0), 4) AS f1,
  round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy FROM (SELECT
  count(*) FILTER (WHERE label = 0 AND score < {t}) AS tn, count(*) FILTER (WHERE label = 0 AND score >= {t}) AS fp,
  count(*) FILTER (WHERE label = 1 AND score < {t}) AS fn, count(*) FILTER (WHERE label = 1 AND score >= {t}) AS tp FROM scored)"""


@register("ml_threshold_metrics", oracle=_thr_sql(0.5) + "\nUNION ALL\n" + _thr_sql(0.4))
def ml_threshold_metrics(spark, sf):
    """Precision / recall / F1 / accuracy at thresholds 0.50 and 0.40, 4-digit rounding."""
    s = _scored(spark, sf)
    return M.threshold_metrics(s, 0.5).unionByName(M.threshold_metrics(s, 0.4))


@register("ml_threshold_report", round_cols=("precision", "recall", "f1"), oracle="""WITH t AS (SELECT * FROM (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.4 AS DOUBLE))) v(threshold)),
p AS (SELECT t.threshold, s.label, CAST(s.score >= t.threshold AS INT) AS pred FROM scored s CROSS JOIN t),
cls AS (SELECT threshold, c AS class,
  count(*) FILTER (WHERE pred = c AND label = c) AS tp, count(*) FILTER (WHERE pred = c) AS npred, count(*) FILTER (WHERE label = c) AS support
  FROM p CROSS JOIN (VALUES (0), (1)) k(c) GROUP BY 1, 2),
m AS (SELECT threshold, CAST(class AS VARCHAR) AS class, coalesce(tp * 1.0 / nullif(npred, 0), 0) AS precision,
  coalesce(tp * 1.0 / nullif(support, 0), 0) AS recall, support FROM cls),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
SELECT threshold, class, precision, recall, f1, support FROM f
UNION ALL SELECT threshold, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f GROUP BY 1
UNION ALL SELECT threshold, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM f GROUP BY 1""")
def ml_threshold_report(spark, sf):
    """Per-class report (precision, recall, f1, support, macro, weighted) at 0.50 / 0.40.
    Thresholds are a 2-row literal crossed with the scores (fan-out x2, fixed)."""
    s = _scored(spark, sf)
    t = spark.createDataFrame([(0.5,), (0.4,)], ["threshold"])
    p = s.crossJoin(F.broadcast(t)).withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))
    rows = []
    for c in (0, 1):
        rows.append(p.groupBy("threshold").agg(
            F.lit(str(c)).alias("class"),
            F.count_if((F.col("pred") == c) & (F.col("label") == c)).alias("tp"),
            F.count_if(F.col("pred") == c).alias("npred"), F.count_if(F.col("label") == c).alias("support")))
    cls = rows[0].unionByName(rows[1])
    f = cls.select("threshold", "class",
                   F.coalesce(F.try_divide(F.col("tp") * 1.0, F.col("npred")), F.lit(0.0)).alias("precision"),
                   F.coalesce(F.try_divide(F.col("tp") * 1.0, F.col("support")), F.lit(0.0)).alias("recall"),
                   "support")
    f = f.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                   F.col("precision") + F.col("recall")), F.lit(0.0)))
    macro = f.groupBy("threshold").agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                                       F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                                       F.sum("support").alias("support"))
    wavg = f.groupBy("threshold").agg(
        F.lit("weighted avg").alias("class"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"), F.sum("support").alias("support"))
    cols = ["threshold", "class", "precision", "recall", "f1", "support"]
    return f.select(*cols).unionByName(macro.select(*cols)).unionByName(wavg.select(*cols))


@register("ml_confusion", round_cols=("sensitivity", "specificity"), oracle="""SELECT tn, fp, fn, tp,
  coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) AS sensitivity, coalesce(tn * 1.0 / nullif(tn + fp, 0), 0) AS specificity FROM (SELECT
  count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM scored)""")
def ml_confusion(spark, sf):
    """Confusion matrix at 0.50 with sensitivity / specificity."""
    c = M.confusion_counts(_scored(spark, sf), 0.5)
    return c.select("tn", "fp", "fn", "tp",
                    F.coalesce(F.try_divide(F.col("tp") * 1.0, F.col("tp") + F.col("fn")), F.lit(0.0)).alias("sensitivity"),
                    F.coalesce(F.try_divide(F.col("tn") * 1.0, F.col("tn") + F.col("fp")), F.lit(0.0)).alias("specificity"))


@register("ml_roc_curve", round_cols=("fpr", "tpr", "threshold"), oracle="WITH " + _CUM_SQL.format(src="scored") + """,
k AS (SELECT c.*, lag(fps) OVER w AS pfp, lead(fps) OVER w AS nfp, lag(tps) OVER w AS ptp, lead(tps) OVER w AS ntp,
  count(*) OVER () AS npts FROM c WINDOW w AS (ORDER BY idx))
SELECT 0.0 AS fpr, 0.0 AS tpr, CAST('inf' AS DOUBLE) AS threshold
UNION ALL SELECT fps * 1.0 / N, tps * 1.0 / P, score FROM k
WHERE idx = 1 OR idx = npts OR nfp - 2 * fps + pfp <> 0 OR ntp - 2 * tps + ptp <> 0""")
def ml_roc_curve(spark, sf):
    """ROC curve points, collinear points dropped, leading (0, 0, inf)."""
    return M.roc_curve(M.cumulative(_scored(spark, sf)))


@register("ml_pr_curve", round_cols=("precision", "recall", "threshold"), oracle="WITH " + _CUM_SQL.format(src="scored") + """
SELECT tps * 1.0 / (tps + fps) AS precision, CASE WHEN P > 0 THEN tps * 1.0 / P ELSE 1.0 END AS recall, score AS threshold FROM c
UNION ALL SELECT 1.0, 0.0, NULL""")
def ml_pr_curve(spark, sf):
    """Precision-recall curve points."""
    return M.pr_curve(M.cumulative(_scored(spark, sf)))


_SPLIT_SQL = """sp AS (SELECT *, CASE WHEN rk <= (n * 70 + 50) // 100 THEN 'train'
    WHEN rk <= (n * 70 + 50) // 100 + (n * 15 + 50) // 100 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', CAST(id AS VARCHAR)))) AS rk,
    count(*) OVER (PARTITION BY label) AS n FROM scored s))"""


@register("ml_split_stratified", oracle=f"""WITH {_SPLIT_SQL}
SELECT split, label, count(*) AS n_rows, CAST(min(rk) AS BIGINT) AS min_rank, CAST(max(rk) AS BIGINT) AS max_rank,
  CAST(sum(id) AS BIGINT) AS id_checksum FROM sp GROUP BY 1, 2""")
def ml_split_stratified(spark, sf):
    """Exact stratified 70/15/15 split in portable md5 order; per-split class
    counts, rank range and an id checksum pin the exact membership (M1)."""
    sp = M.stratified_split(_scored(spark, sf), "id", "label")
    n = sp.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("id").cast("bigint").alias("id_checksum"))
    upto = F.sum("n_rows").over(Window.partitionBy("label").orderBy(F.array_position(F.array(F.lit("train"), F.lit("val"), F.lit("test")), F.col("split"))))
    return n.select("split", "label", "n_rows", (upto - F.col("n_rows") + 1).alias("min_rank"), upto.alias("max_rank"), "id_checksum")


@register("ml_kfold", oracle="""SELECT fold, label, count(*) AS n_rows, CAST(sum(id) AS BIGINT) AS id_checksum FROM (
  SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', CAST(id AS VARCHAR)))) - 1) % 5 AS INT) AS fold FROM scored)
GROUP BY 1, 2
UNION ALL SELECT fold + 5, label, count(*), CAST(sum(id) AS BIGINT) FROM (
  SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat('43|', CAST(id AS VARCHAR)))) - 1) % 5 AS INT) AS fold FROM scored)
GROUP BY 1, 2""")
def ml_kfold(spark, sf):
    """Stratified 5-fold assignment, and a second repeat with a new seed (folds 5-9) (M3)."""
    s = _scored(spark, sf)
    a = M.kfold(s, "id", "label", 5, 42)
    b = M.kfold(s, "id", "label", 5, 43).withColumn("fold", F.col("fold") + 5)
    agg = [F.count(F.lit(1)).alias("n_rows"), F.sum("id").cast("bigint").alias("id_checksum")]
    return a.groupBy("fold", "label").agg(*agg).unionByName(b.groupBy("fold", "label").agg(*agg))


@register("ml_split_time", oracle=feat_with("""
, o AS (SELECT id, calculated_overdue, row_number() OVER (ORDER BY created_quarter, created_month, id) AS rn, count(*) OVER () AS n FROM feat),
s AS (SELECT *, CASE WHEN rn <= CAST(floor(n * 0.70) AS BIGINT) THEN 'train' WHEN rn <= CAST(floor(n * 0.85) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM o)
SELECT split, count(*) AS n_rows, CAST(sum(calculated_overdue) AS BIGINT) AS n_overdue, CAST(sum(id) AS BIGINT) AS id_checksum FROM s GROUP BY 1""", "halfway"))
def ml_split_time(spark, sf):
    """Chronological 70/15/15 split on (quarter, month, id) by range partitions with
    offsets, no single-partition window (M2, W6)."""
    f = _feat(spark, sf, "halfway")
    rn = global_row_number(f.select("id", "created_quarter", "created_month", "calculated_overdue"), ["created_quarter", "created_month", "id"], "rn")
    n = f.agg(F.count(F.lit(1)).alias("n"))
    s = rn.crossJoin(F.broadcast(n)).withColumn(
        "split", F.when(F.col("rn") <= F.floor(F.col("n") * 0.70), "train")
        .when(F.col("rn") <= F.floor(F.col("n") * 0.85), "val").otherwise("test"))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"),
                                  F.sum("calculated_overdue").cast("bigint").alias("n_overdue"),
                                  F.sum("id").cast("bigint").alias("id_checksum"))


@register("ml_gen_gap", round_cols=("train_val_pr", "test_pr", "generalization_gap"), oracle=f"""WITH {_SPLIT_SQL},
tv AS (SELECT * FROM sp WHERE split <> 'test'), te AS (SELECT * FROM sp WHERE split = 'test'),
""" + _CUM_SQL.format(src="tv").replace("g AS", "g1 AS").replace("FROM g)", "FROM g1)").replace("c AS", "c1 AS") + """,
""" + _CUM_SQL.format(src="te").replace("g AS", "g2 AS").replace("FROM g)", "FROM g2)").replace("c AS", "c2 AS") + """,
a1 AS (SELECT sum(pos / P * tps / (tps + fps)) AS ap FROM c1), a2 AS (SELECT sum(pos / P * tps / (tps + fps)) AS ap FROM c2)
SELECT a1.ap AS train_val_pr, a2.ap AS test_pr, abs(a1.ap - a2.ap) AS generalization_gap FROM a1, a2""")
def ml_gen_gap(spark, sf):
    """Generalisation gap |AP(train+val) - AP(test)| on the stratified split."""
    sp = M.stratified_split(_scored(spark, sf), "id", "label")
    a = M.average_precision(M.cumulative(sp.filter(F.col("split") != "test"))).withColumnRenamed(
        "average_precision", "train_val_pr")
    b = M.average_precision(M.cumulative(sp.filter(F.col("split") == "test"))).withColumnRenamed(
        "average_precision", "test_pr")
    return a.crossJoin(b).withColumn("generalization_gap", F.abs(F.col("train_val_pr") - F.col("test_pr")))


@register("ml_prob_hist", oracle="""SELECT label AS outcome, CAST(least(floor(score * 30), 29) AS INT) AS bin, count(*) AS count
FROM scored GROUP BY 1, 2""")
def ml_prob_hist(spark, sf):
    """Predicted-probability histogram by outcome, 30 bins on [0, 1]."""
    s = _scored(spark, sf)
    return s.groupBy(F.col("label").alias("outcome"),
                     F.least(F.floor(F.col("score") * 30), F.lit(29)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))


@register("ml_risk_band", oracle=f"""SELECT CASE WHEN score >= {RISK_BADGE[0][0]} THEN 'Critical Risk' WHEN score >= {RISK_BADGE[1][0]} THEN 'High Risk'
  WHEN score >= {RISK_BADGE[2][0]} THEN 'Moderate Risk' ELSE 'Low Risk - On Track' END AS risk_badge,
  CASE WHEN score * 100 < {GAUGE_BANDS[0]} THEN 'green' WHEN score * 100 < {GAUGE_BANDS[1]} THEN 'orange' ELSE 'red' END AS gauge_band,
  count(*) AS n, CAST(sum(label) AS BIGINT) AS n_overdue FROM scored GROUP BY 1, 2""")
def ml_risk_band(spark, sf):
    """Probability -> risk badge (>= .35 / .20 / .10) and gauge band (20 / 35)."""
    s = _scored(spark, sf)
    badge = (F.when(F.col("score") >= RISK_BADGE[0][0], "Critical Risk")
             .when(F.col("score") >= RISK_BADGE[1][0], "High Risk")
             .when(F.col("score") >= RISK_BADGE[2][0], "Moderate Risk").otherwise("Low Risk - On Track"))
    band = (F.when(F.col("score") * 100 < GAUGE_BANDS[0], "green")
            .when(F.col("score") * 100 < GAUGE_BANDS[1], "orange").otherwise("red"))
    return s.groupBy(badge.alias("risk_badge"), band.alias("gauge_band")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("n_overdue"))


_MAR_COLS = ("planned_duration", "creation_to_planned_start", "num_revisions", "revision_recency",
             "dept_past_overdue_rate", "num_ma_revisions", "num_kpi_revisions", "task_comment_count",
             "num_subtasks", "risk_mapping", "status_encoded", "kpi_status_ordinal")


@register("ml_mean_abs_rank", round_cols=("mean_abs",), oracle=feat_with(
    "SELECT feature, mean_abs FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(abs({c})) AS mean_abs FROM feat" for c in _MAR_COLS)
    + ") ORDER BY mean_abs DESC, feature LIMIT 10"))
def ml_mean_abs_rank(spark, sf):
    """Mean |value| ranking over a per-row contribution matrix, top 10 (M18; here
    the matrix is the creation feature table — computing SHAP itself is not built)."""
    f = _feat(spark, sf)
    one = f.agg(*[F.avg(F.abs(F.col(c).cast("double"))).alias(f"{c}|mean_abs") for c in _MAR_COLS])
    from ..operators.aggs import _stack
    return _stack(one, _MAR_COLS, ["mean_abs"]).orderBy(F.col("mean_abs").desc(), "feature").limit(10)
