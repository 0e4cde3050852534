"""Registered queries: dashboard and cohort analytics over the checkpoint datasets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics as an
from ..sources.roles import roles
from . import features as feat
from ..functions.scalar import INF, bin_case_sql
from .catalog import register
from .oracle_wide import feat_with


def _feat(spark, sf, ckpt="creation"):
    return feat.checkpoint_dataset(feat.feature_table(spark, sf), ckpt)


def _challenge_flags(r):
    """Per-task challenge counts/flags from the four junctions (task, its subtasks,
    its KPI via the parent) — pre-aggregated before joining (J5, A3)."""
    tc = r.task_challenge.groupBy(F.col("task_id").alias("_t1")).agg(F.count(F.lit(1)).alias("num_challenges"))
    sc = (r.subtask_challenge.join(r.sub_task.select(F.col("id").alias("_sid"), "task_id"),
                                   F.col("subtask_id") == F.col("_sid"))
          .groupBy(F.col("task_id").alias("_t2")).agg(F.count(F.lit(1)).alias("num_subtask_challenges")))
    kc = r.kpi_challenge.groupBy(F.col("kpi_id").alias("_k1")).agg(F.count(F.lit(1)).alias("num_kpi_challenges"))
    kp = r.kpi_potential_challenge.groupBy(F.col("kpi_id").alias("_k2")).agg(
        F.count(F.lit(1)).alias("num_kpi_potential_challenges"))
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    t = (r.task.select("id", "major_activity_id")
         .join(ma, F.col("major_activity_id") == F.col("_maid"), "left")
         .join(tc, F.col("id") == F.col("_t1"), "left")
         .join(sc, F.col("id") == F.col("_t2"), "left")
         .join(kc, F.col("kpi_id") == F.col("_k1"), "left")
         .join(kp, F.col("kpi_id") == F.col("_k2"), "left"))
    cols = ["num_challenges", "num_subtask_challenges", "num_kpi_challenges", "num_kpi_potential_challenges"]
    flags = {"num_challenges": "has_challenges", "num_subtask_challenges": "has_subtask_challenge",
             "num_kpi_challenges": "has_kpi_challenge",
             "num_kpi_potential_challenges": "has_kpi_potential_challenge"}
    return t.select(F.col("id").alias("_cid"),
                    *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cols],
                    *[(F.coalesce(F.col(c), F.lit(0)) > 0).cast("int").alias(f) for c, f in flags.items()])


CHALLENGE_SQL = """chal AS (
  SELECT t.id AS cid,
    coalesce(tc.n, 0) AS num_challenges, coalesce(sc.n, 0) AS num_subtask_challenges,
    coalesce(kc.n, 0) AS num_kpi_challenges, coalesce(kp.n, 0) AS num_kpi_potential_challenges,
    CAST(coalesce(tc.n, 0) > 0 AS INT) AS has_challenges, CAST(coalesce(sc.n, 0) > 0 AS INT) AS has_subtask_challenge,
    CAST(coalesce(kc.n, 0) > 0 AS INT) AS has_kpi_challenge, CAST(coalesce(kp.n, 0) > 0 AS INT) AS has_kpi_potential_challenge
  FROM task t LEFT JOIN major_activity ma ON ma.id = t.major_activity_id
  LEFT JOIN (SELECT task_id, count(*) AS n FROM task_challenge GROUP BY 1) tc ON tc.task_id = t.id
  LEFT JOIN (SELECT st.task_id, count(*) AS n FROM subtask_challenge sc JOIN sub_task st ON st.id = sc.subtask_id GROUP BY 1) sc ON sc.task_id = t.id
  LEFT JOIN (SELECT kpi_id, count(*) AS n FROM kpi_challenge GROUP BY 1) kc ON kc.kpi_id = ma.kpi_id
  LEFT JOIN (SELECT kpi_id, count(*) AS n FROM kpi_potential_challenge GROUP BY 1) kp ON kp.kpi_id = ma.kpi_id)"""


def _feat_chal(spark, sf, ckpt="halfway"):
    r = roles(spark, sf)
    f = feat.checkpoint_dataset(feat.feature_table(spark, sf), ckpt)
    return f.join(_challenge_flags(r), F.col("id") == F.col("_cid"), "left").drop("_cid")


@register("an_dept_risk_tiers", round_cols=("actual_overdue_pct", "dept_hist_rate_mean"),
          oracle=feat_with("""SELECT * FROM (SELECT
  CASE WHEN dept_past_overdue_rate > -0.001 AND dept_past_overdue_rate <= 0.1 THEN 'Low Risk (0-10%)'
       WHEN dept_past_overdue_rate > 0.1 AND dept_past_overdue_rate <= 0.2 THEN 'Moderate (10-20%)'
       WHEN dept_past_overdue_rate > 0.2 AND dept_past_overdue_rate <= 0.3 THEN 'High (20-30%)'
       WHEN dept_past_overdue_rate > 0.3 AND dept_past_overdue_rate <= 1.0 THEN 'Critical (>30%)' END AS risk_tier,
  CASE WHEN dept_past_overdue_rate > -0.001 AND dept_past_overdue_rate <= 0.1 THEN 0
       WHEN dept_past_overdue_rate > 0.1 AND dept_past_overdue_rate <= 0.2 THEN 1
       WHEN dept_past_overdue_rate > 0.2 AND dept_past_overdue_rate <= 0.3 THEN 2
       WHEN dept_past_overdue_rate > 0.3 AND dept_past_overdue_rate <= 1.0 THEN 3 END AS tier_order,
  count(calculated_overdue) AS num_tasks, avg(calculated_overdue) * 100 AS actual_overdue_pct,
  avg(dept_past_overdue_rate) AS dept_hist_rate_mean
FROM feat GROUP BY 1, 2) WHERE risk_tier IS NOT NULL"""))
def an_dept_risk_tiers(spark, sf):
    """Department risk tiers from the historical rate vs actual rate."""
    return an.dept_risk_tiers(_feat(spark, sf)).orderBy("tier_order")


@register("an_cross_dept", round_cols=("overdue_rate_pct",), oracle=feat_with("""SELECT d.is_cross_dept, d.segment,
  coalesce(g.r, 0.0) AS overdue_rate_pct, coalesce(g.n, 0) AS num_tasks
FROM (VALUES (0, 'Single Department'), (1, 'Cross-Department')) d(is_cross_dept, segment)
LEFT JOIN (SELECT is_cross_dept, avg(calculated_overdue) * 100 AS r, count(*) AS n FROM feat GROUP BY 1) g
  ON g.is_cross_dept = d.is_cross_dept"""))
def an_cross_dept(spark, sf):
    """Cross-department impact, both segments always present."""
    return an.two_segment_rate(_feat(spark, sf), "is_cross_dept", ["Single Department", "Cross-Department"])


@register("an_subtask_effect", round_cols=("overdue_rate_pct",), oracle=feat_with("""SELECT d.has_subtasks, d.segment,
  coalesce(g.r, 0.0) AS overdue_rate_pct, coalesce(g.n, 0) AS num_tasks
FROM (VALUES (0, 'No Subtasks'), (1, 'Has Subtasks')) d(has_subtasks, segment)
LEFT JOIN (SELECT has_subtasks, avg(calculated_overdue) * 100 AS r, count(*) AS n FROM feat GROUP BY 1) g
  ON g.has_subtasks = d.has_subtasks""", "halfway"))
def an_subtask_effect(spark, sf):
    """Subtask protection effect at halfway (D3)."""
    return an.two_segment_rate(_feat(spark, sf, "halfway"), "has_subtasks", ["No Subtasks", "Has Subtasks"])


@register("an_revision_spiral", round_cols=("overdue_rate", "overdue_rate_pct"), oracle=feat_with("""SELECT d.revisions, d.sort_key,
  g.num_tasks, g.overdue_rate, g.overdue_rate * 100 AS overdue_rate_pct
FROM (VALUES ('0', 0), ('1', 1), ('2', 2), ('3+', 3)) d(revisions, sort_key)
LEFT JOIN (SELECT CASE WHEN num_revisions <= 0 THEN '0' WHEN num_revisions = 1 THEN '1' WHEN num_revisions = 2 THEN '2' ELSE '3+' END AS revisions,
  count(calculated_overdue) AS num_tasks, avg(calculated_overdue) AS overdue_rate FROM feat GROUP BY 1) g USING (revisions)""", "halfway"))
def an_revision_spiral(spark, sf):
    """Revision death spiral 0/1/2/3+, fixed order incl. empty buckets."""
    return an.revision_spiral(_feat(spark, sf, "halfway"))


@register("an_retroactive", round_cols=("overdue_rate_pct", "share_pct"), oracle=feat_with("""SELECT segment,
  avg(calculated_overdue) * 100 AS overdue_rate_pct, count(*) AS num_tasks,
  count(*) * 100.0 / sum(count(*)) OVER () AS share_pct
FROM (SELECT CASE WHEN creation_to_planned_start < 0 THEN 'Retroactive Creation' ELSE 'Planned Ahead' END AS segment,
  calculated_overdue FROM feat) GROUP BY 1"""))
def an_retroactive(spark, sf):
    """Retroactive-creation impact and share."""
    f = _feat(spark, sf)
    seg = F.when(F.col("creation_to_planned_start") < 0, "Retroactive Creation").otherwise("Planned Ahead")
    g = f.groupBy(seg.alias("segment")).agg((F.avg("calculated_overdue") * 100).alias("overdue_rate_pct"),
                                             F.count(F.lit(1)).alias("num_tasks"))
    return g.withColumn("share_pct", F.col("num_tasks") * 100.0 / F.sum("num_tasks").over(Window.partitionBy()))


@register("an_seasonality", round_cols=("overdue_rate", "overdue_rate_pct"), oracle=feat_with("""SELECT dimension, value,
  count(calculated_overdue) AS num_tasks, avg(calculated_overdue) AS overdue_rate, avg(calculated_overdue) * 100 AS overdue_rate_pct
FROM (SELECT 'month' AS dimension, CAST(created_month AS VARCHAR) AS value, calculated_overdue FROM feat
      UNION ALL SELECT 'quarter', CAST(created_quarter AS VARCHAR), calculated_overdue FROM feat
      UNION ALL SELECT 'weekday', CAST(created_dow AS VARCHAR), calculated_overdue FROM feat) GROUP BY 1, 2"""))
def an_seasonality(spark, sf):
    """Seasonality by month / quarter / weekday in one scan and one shuffle."""
    f = _feat(spark, sf)
    return an.long_segments(f, {"month": F.col("created_month"), "quarter": F.col("created_quarter"),
                                "weekday": F.col("created_dow")})


@register("an_class_balance", round_cols=("overdue_pct", "imbalance_ratio", "mean_planned_duration"),
          oracle=feat_with("""SELECT count(*) AS total, CAST(sum(calculated_overdue) AS BIGINT) AS overdue,
  count(*) - CAST(sum(calculated_overdue) AS BIGINT) AS not_overdue,
  CASE WHEN count(*) > 0 THEN sum(calculated_overdue) * 100.0 / count(*) ELSE 0.0 END AS overdue_pct,
  CASE WHEN sum(calculated_overdue) > 0 THEN (count(*) - sum(calculated_overdue)) / sum(calculated_overdue) ELSE 0.0 END AS imbalance_ratio,
  avg(planned_duration) AS mean_planned_duration FROM feat"""))
def an_class_balance(spark, sf):
    """Class balance, imbalance ratio and mean planned duration tile."""
    f = _feat(spark, sf)
    one = f.agg(F.count(F.lit(1)).alias("total"), F.sum("calculated_overdue").cast("bigint").alias("overdue"),
                F.avg("planned_duration").alias("mean_planned_duration"))
    return one.select(
        "total", "overdue", (F.col("total") - F.col("overdue")).alias("not_overdue"),
        F.when(F.col("total") > 0, F.col("overdue") * 100.0 / F.col("total")).otherwise(0.0).alias("overdue_pct"),
        F.when(F.col("overdue") > 0, (F.col("total") - F.col("overdue")) / F.col("overdue"))
        .otherwise(0.0).alias("imbalance_ratio"), "mean_planned_duration")


@register("an_peak_month", round_cols=("worst_rate", "best_rate"), oracle=feat_with("""SELECT
  arg_max(created_month, (n, -created_month)) AS peak_month, max(n) AS peak_month_tasks,
  arg_max(created_month, (r, -created_month)) AS worst_month, max(r) AS worst_rate,
  arg_min(created_month, (r, created_month)) AS best_month, min(r) AS best_rate
FROM (SELECT created_month, count(*) AS n, avg(calculated_overdue) AS r FROM feat GROUP BY 1)"""))
def an_peak_month(spark, sf):
    """Peak month (first on ties) and worst / best month by rate via max_by."""
    f = _feat(spark, sf)
    m = f.groupBy("created_month").agg(F.count(F.lit(1)).alias("n"), F.avg("calculated_overdue").alias("r"))
    return m.agg(
        F.max_by("created_month", F.struct("n", (-F.col("created_month")).alias("k"))).alias("peak_month"),
        F.max("n").alias("peak_month_tasks"),
        F.max_by("created_month", F.struct("r", (-F.col("created_month")).alias("k"))).alias("worst_month"),
        F.max("r").alias("worst_rate"),
        F.min_by("created_month", F.struct("r", "created_month")).alias("best_month"),
        F.min("r").alias("best_rate"))


@register("an_target_source", round_cols=("pct",), oracle=feat_with("""SELECT target_source, count(*) AS num_tasks,
  count(*) * 100.0 / sum(count(*)) OVER () AS pct, avg(calculated_overdue) AS overdue_rate FROM feat GROUP BY 1""")
          .replace("avg(calculated_overdue) AS overdue_rate", "round(avg(calculated_overdue), 6) AS overdue_rate"))
def an_target_source(spark, sf):
    """Target-source breakdown."""
    g = _feat(spark, sf).groupBy("target_source").agg(
        F.count(F.lit(1)).alias("num_tasks"), F.avg("calculated_overdue").alias("overdue_rate"))
    return g.withColumn("pct", F.col("num_tasks") * 100.0 / F.sum("num_tasks").over(Window.partitionBy()))


# Bin edges and labels; the outer ends are open, so that no row falls outside.
_BIN_SPECS = {
    "duration": ("planned_duration", (-INF, -1, 0, 7, 30, INF), ("Negative", "Same Day (0d)", "1-7 Days", "8-30 Days", ">30 Days")),
    "revisions": ("num_revisions", (-INF, 0, 2, 5, INF), ("0 Revs", "1-2 Revs", "3-5 Revs", ">5 Revs")),
    "halfway_completion": ("subtask_completion_pct_at_halfway", (-INF, 0, 0.25, 0.5, 0.75, INF),
                           ("0% Done", "1-25%", "26-50%", "51-75%", "76-100%")),
    "comments": ("task_comment_count", (-INF, 0, 2, INF), ("0 Comments", "1-2 Comments", ">2 Comments")),
}
_case_sql = bin_case_sql


@register("bin_fixed", round_cols=("overdue_rate", "overdue_rate_pct"), oracle=feat_with(
    "SELECT dimension, bin, bin_order, count(calculated_overdue) AS num_tasks, avg(calculated_overdue) AS overdue_rate, "
    "avg(calculated_overdue) * 100 AS overdue_rate_pct FROM (" + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {_case_sql(c, e, l)} AS bin, {_case_sql(c, e, l, True)} AS bin_order, calculated_overdue FROM feat"
        for d, (c, e, l) in _BIN_SPECS.items()) + ") GROUP BY 1, 2, 3", "halfway"))
def bin_fixed(spark, sf):
    """Fixed-edge right-closed bins (pd.cut) for duration, revisions, halfway completion
    and comments -> rate, in one scan (D11, E10)."""
    from ..functions.scalar import bin_index, right_closed_bin
    f = _feat(spark, sf, "halfway")
    arr = F.array(*[F.struct(F.lit(d).alias("dimension"), right_closed_bin(c, e, l).alias("bin"),
                             bin_index(c, e).alias("bin_order"))
                    for d, (c, e, l) in _BIN_SPECS.items()])
    x = f.select(F.explode(arr).alias("_d"), "calculated_overdue").select("_d.*", "calculated_overdue")
    return an.rate_by(x, ["dimension", "bin", "bin_order"])


_ACT_SPECS = {
    "task_comments": ("task_comment_count", (-INF, 0, 1, 3, 6, INF), ("0", "1", "2-3", "4-6", "6+")),
    "sub_churn": ("avg_sub_status_changes", (-INF, 0, 1, 2, 3, INF), ("0", "1", "2", "3", "3+")),
    "ma_revisions": ("num_ma_revisions", (-INF, 0, 5, 20, 50, 100, INF), ("0", "1-5", "6-20", "21-50", "51-100", "100+")),
    "kpi_revisions": ("num_kpi_revisions", (-INF, 0, 1, 3, 5, 10, INF), ("0", "1", "2-3", "4-5", "6-10", "10+")),
}


@register("an_activity_bins", round_cols=("overdue_rate", "overdue_rate_pct"), oracle=feat_with(
    "SELECT dimension, bin, bin_order, count(calculated_overdue) AS num_tasks, avg(calculated_overdue) AS overdue_rate, "
    "avg(calculated_overdue) * 100 AS overdue_rate_pct FROM (" + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {_case_sql(c, e, l)} AS bin, {_case_sql(c, e, l, True)} AS bin_order, calculated_overdue FROM feat"
        for d, (c, e, l) in _ACT_SPECS.items()) + ") GROUP BY 1, 2, 3", "halfway"))
def an_activity_bins(spark, sf):
    """Comment / churn / parent and KPI revision bins -> rate."""
    from ..functions.scalar import bin_index, right_closed_bin
    f = _feat(spark, sf, "halfway")
    arr = F.array(*[F.struct(F.lit(d).alias("dimension"), right_closed_bin(c, e, l).alias("bin"),
                             bin_index(c, e).alias("bin_order"))
                    for d, (c, e, l) in _ACT_SPECS.items()])
    x = f.select(F.explode(arr).alias("_d"), "calculated_overdue").select("_d.*", "calculated_overdue")
    return an.rate_by(x, ["dimension", "bin", "bin_order"])


@register("an_challenge_lift", round_cols=("pct_tasks_affected", "rate_present_pct", "rate_absent_pct", "lift"),
          oracle=feat_with(f""", {CHALLENGE_SQL},
fjc AS (SELECT f.calculated_overdue, c.* FROM feat f LEFT JOIN chal c ON c.cid = f.id),
one AS (SELECT
  avg(has_challenges) AS p1, avg(calculated_overdue) FILTER (WHERE has_challenges = 1) AS a1, avg(calculated_overdue) FILTER (WHERE has_challenges = 0) AS b1,
  avg(has_kpi_challenge) AS p2, avg(calculated_overdue) FILTER (WHERE has_kpi_challenge = 1) AS a2, avg(calculated_overdue) FILTER (WHERE has_kpi_challenge = 0) AS b2,
  avg(has_subtask_challenge) AS p3, avg(calculated_overdue) FILTER (WHERE has_subtask_challenge = 1) AS a3, avg(calculated_overdue) FILTER (WHERE has_subtask_challenge = 0) AS b3,
  avg(has_kpi_potential_challenge) AS p4, avg(calculated_overdue) FILTER (WHERE has_kpi_potential_challenge = 1) AS a4, avg(calculated_overdue) FILTER (WHERE has_kpi_potential_challenge = 0) AS b4
  FROM fjc)
SELECT challenge_type, p * 100 AS pct_tasks_affected, r1 * 100 AS rate_present_pct, r0 * 100 AS rate_absent_pct,
  CASE WHEN r0 > 0 THEN r1 / r0 ELSE 0.0 END AS lift FROM (
  SELECT 'Task Challenge' AS challenge_type, p1 AS p, a1 AS r1, b1 AS r0 FROM one
  UNION ALL SELECT 'KPI Challenge', p2, a2, b2 FROM one
  UNION ALL SELECT 'Subtask Challenge', p3, a3, b3 FROM one
  UNION ALL SELECT 'KPI Potential Challenge', p4, a4, b4 FROM one)""", "halfway"))
def an_challenge_lift(spark, sf):
    """Challenge-type comparison: affected %, rate present/absent, lift."""
    f = _feat_chal(spark, sf)
    return an.lift_table(f, {"Task Challenge": "has_challenges", "KPI Challenge": "has_kpi_challenge",
                             "Subtask Challenge": "has_subtask_challenge",
                             "KPI Potential Challenge": "has_kpi_potential_challenge"})
