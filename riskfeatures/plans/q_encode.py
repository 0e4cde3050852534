"""Registered queries: encoding, imputation, binning, scalar features,
preprocessing, personas, ordering and remaining cohort analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import APPROVAL_ORDER, AS_OF, STATUS_ORDER
from ..functions import encode as enc
from ..functions.quantiles import exact_quantiles
from ..functions.scalar import INF, bin_case_sql, clip, clipped_ratio, ordinal, right_closed_bin, bin_index
from ..functions.temporal import calendar_parts, date_days, floor_days, lit_date
from ..operators import aggs as ag
from ..operators import analytics as an
from ..operators import cutoffs as cut
from ..operators import labels as lbl
from ..operators import metrics as M
from ..operators import ml
from ..sources.roles import roles
from .catalog import register
from .oracle_wide import AS_OF_SQL, BASE_CTES, TWO_TIER, feat_with
from .q_analytics import CHALLENGE_SQL, _feat, _feat_chal

B = f"WITH {BASE_CTES}\n"


def _lbase(r):
    return lbl.with_three_tier(cut.base_tasks(r.task), r.task_history)


@register("enc_ordinal", oracle="""SELECT id, CAST(CASE status WHEN 'not_started' THEN 0 WHEN 'ongoing' THEN 1 WHEN 'in_progress' THEN 1
  WHEN 'completed' THEN 2 WHEN 'terminated' THEN 3 WHEN 'archived' THEN 4 ELSE 1 END AS INT) AS status_ord,
  CAST(CASE approval_status WHEN 'pending' THEN 0 WHEN 'in_review' THEN 1 WHEN 'approved' THEN 2 WHEN 'rejected' THEN 3 ELSE 1 END AS INT) AS approval_ord,
  CAST(CASE lead_approval_status WHEN 'pending' THEN 0 WHEN 'in_review' THEN 1 WHEN 'approved' THEN 2 WHEN 'rejected' THEN 3 ELSE 1 END AS INT) AS lead_approval_ord
FROM task""")
def enc_ordinal(spark, sf):
    """Ordinal encoding with fallback 1 for unknown / NULL."""
    t = roles(spark, sf).task
    return t.select("id", ordinal("status", STATUS_ORDER).alias("status_ord"),
                    ordinal("approval_status", APPROVAL_ORDER).alias("approval_ord"),
                    ordinal("lead_approval_status", APPROVAL_ORDER).alias("lead_approval_ord"))


@register("enc_onehot", oracle="""SELECT id, CAST(weight_level = 'high' AS INT) AS wl_high, CAST(weight_level = 'low' AS INT) AS wl_low,
  CAST(weight_level = 'mid' AS INT) AS wl_mid FROM task""")
def enc_onehot(spark, sf):
    """One-hot with prefix over the (sorted) weight-level vocabulary."""
    t = roles(spark, sf).task.select("id", "weight_level")
    return enc.one_hot(t, "weight_level", ["high", "mid", "low"], "wl").drop("weight_level")


@register("enc_target", round_cols=("dept_target_enc",), oracle=B + """, bd AS (SELECT b.id, b.calculated_overdue,
  coalesce(p.department_id, b.department_id) AS dept_id FROM base b LEFT JOIN position p ON p.id = b.position_id),
g AS (SELECT dept_id, avg(calculated_overdue) AS te FROM bd GROUP BY 1)
SELECT bd.id, bd.dept_id, coalesce(g.te, (SELECT avg(calculated_overdue) FROM bd)) AS dept_target_enc
FROM bd LEFT JOIN g ON g.dept_id IS NOT DISTINCT FROM bd.dept_id""")
def enc_target(spark, sf):
    """Target (mean) encoding of the resolved department, unknown -> global mean."""
    r = roles(spark, sf)
    b = _lbase(r)
    p = r.position.select(F.col("id").alias("_pid"), F.col("department_id").alias("_pd"))
    bd = b.join(p, F.col("position_id") == F.col("_pid"), "left").select(
        "id", "calculated_overdue", F.coalesce("_pd", "department_id").alias("dept_id"))
    return enc.target_encode(bd, "dept_id", "calculated_overdue", "dept_target_enc").drop("calculated_overdue")


@register("enc_target_oof", round_cols=("dept_target_enc_oof",), oracle=B + """, bd AS (SELECT b.id, b.calculated_overdue,
  coalesce(p.department_id, b.department_id) AS dept_id,
  CAST((row_number() OVER (PARTITION BY b.calculated_overdue ORDER BY md5(concat('42|', CAST(b.id AS VARCHAR)))) - 1) % 5 AS INT) AS fold
  FROM base b LEFT JOIN position p ON p.id = b.position_id),
gf AS (SELECT dept_id, fold, sum(calculated_overdue) AS sf, count(*) AS nf FROM bd GROUP BY 1, 2),
g AS (SELECT dept_id, sum(calculated_overdue) AS sg, count(*) AS ng FROM bd GROUP BY 1),
fo AS (SELECT fold, sum(calculated_overdue) AS sfo, count(*) AS nfo FROM bd GROUP BY 1),
t AS (SELECT sum(calculated_overdue) AS st, count(*) AS nt FROM bd)
SELECT bd.id, bd.dept_id, bd.fold,
  coalesce((g.sg - gf.sf) * 1.0 / nullif(g.ng - gf.nf, 0), (t.st - fo.sfo) * 1.0 / (t.nt - fo.nfo)) AS dept_target_enc_oof
FROM bd JOIN gf ON gf.dept_id IS NOT DISTINCT FROM bd.dept_id AND gf.fold = bd.fold
JOIN g ON g.dept_id IS NOT DISTINCT FROM bd.dept_id JOIN fo ON fo.fold = bd.fold CROSS JOIN t""")
def enc_target_oof(spark, sf):
    """Fold-safe (out-of-fold) target encoding: (group total - fold) / (n - n_fold)."""
    r = roles(spark, sf)
    b = _lbase(r)
    p = r.position.select(F.col("id").alias("_pid"), F.col("department_id").alias("_pd"))
    bd = b.join(p, F.col("position_id") == F.col("_pid"), "left").select(
        "id", "calculated_overdue", F.coalesce("_pd", "department_id").alias("dept_id"))
    bd = M.kfold(bd, "id", "calculated_overdue", 5, 42)
    return enc.target_encode_oof(bd, "dept_id", "calculated_overdue", "fold", "dept_target_enc_oof") \
        .drop("calculated_overdue")


@register("enc_cat_codes", oracle="""SELECT t.id, t.status, CAST(coalesce(c.code, -1) AS INT) AS status_code FROM task t
LEFT JOIN (SELECT status, dense_rank() OVER (ORDER BY status) - 1 AS code FROM (SELECT DISTINCT status FROM task WHERE status IS NOT NULL)) c
  ON c.status = t.status""")
def enc_cat_codes(spark, sf):
    """Alphabetical category codes, NULL -> -1 (E5)."""
    t = roles(spark, sf).task.select("id", "status")
    return enc.category_codes(t, "status", "status_code")


def _imp_input(r):
    rc = (r.task_history.filter(F.col("history_relation_id").isNotNull())
          .groupBy(F.col("history_relation_id").alias("_rid")).agg(F.count(F.lit(1)).alias("num_revisions")))
    p = r.position.select(F.col("id").alias("_pid"), F.col("user_id").alias("_uid"))
    t = r.task.withColumn("_y", lbl.two_tier())
    er = (t.join(p, F.col("position_id") == F.col("_pid")).filter(F.col("_uid").isNotNull())
          .groupBy("_uid").agg(F.avg("_y").alias("emp_rate")))
    return (t.join(rc, F.col("id") == F.col("_rid"), "left")
            .join(p, F.col("position_id") == F.col("_pid"), "left")
            .join(er, "_uid", "left")
            .select("id", F.col("num_revisions").cast("double").alias("num_revisions"), "emp_rate",
                    F.col("position_id").cast("string").alias("position_key"),
                    F.when(F.col("status").isin(*STATUS_ORDER), ordinal("status", STATUS_ORDER, None))
                    .alias("status_ord")))


_IMP_SQL = f"""WITH rc AS (SELECT history_relation_id AS rid, count(*) AS n FROM task_history WHERE history_relation_id IS NOT NULL GROUP BY 1),
t2 AS (SELECT t.*, {TWO_TIER} AS y FROM task t),
er AS (SELECT p.user_id AS uid, avg(t2.y) AS emp_rate FROM t2 JOIN position p ON p.id = t2.position_id WHERE p.user_id IS NOT NULL GROUP BY 1),
raw AS (SELECT t2.id, CAST(rc.n AS DOUBLE) AS num_revisions, er.emp_rate, CAST(t2.position_id AS VARCHAR) AS position_key,
  CASE t2.status WHEN 'not_started' THEN 0 WHEN 'ongoing' THEN 1 WHEN 'in_progress' THEN 1 WHEN 'completed' THEN 2
    WHEN 'terminated' THEN 3 WHEN 'archived' THEN 4 END AS status_ord
  FROM t2 LEFT JOIN rc ON rc.rid = t2.id LEFT JOIN position p ON p.id = t2.position_id LEFT JOIN er ON er.uid = p.user_id)
"""


@register("imp_policy", round_cols=("emp_rate",), oracle=_IMP_SQL + """SELECT id, coalesce(num_revisions, 0) AS num_revisions,
  coalesce(emp_rate, (SELECT avg(emp_rate) FROM raw)) AS emp_rate, coalesce(position_key, 'UNKNOWN') AS position_key,
  CAST(coalesce(status_ord, 1) AS INT) AS status_ord FROM raw""")
def imp_policy(spark, sf):
    """Per-column fill policy: zero for counts, global mean for rates, 'UNKNOWN'
    for ids, 1 for ordinals (E6, E7, E8, T25)."""
    raw = _imp_input(roles(spark, sf))
    out = enc.fill_zero(raw, ["num_revisions"])
    out = enc.fill_mean(out, ["emp_rate"])
    return enc.fill_constant(out, {"position_key": "UNKNOWN", "status_ord": 1})


@register("imp_impact", round_cols=("null_pct_before", "null_pct_after", "mean_before", "mean_after"), oracle=_IMP_SQL + """,
imp AS (SELECT id, coalesce(num_revisions, 0) AS num_revisions, coalesce(emp_rate, (SELECT avg(emp_rate) FROM raw)) AS emp_rate FROM raw)
SELECT 'num_revisions' AS feature, (SELECT (count(*) - count(num_revisions)) * 100.0 / count(*) FROM raw) AS null_pct_before,
  (SELECT (count(*) - count(num_revisions)) * 100.0 / count(*) FROM imp) AS null_pct_after,
  (SELECT avg(num_revisions) FROM raw) AS mean_before, (SELECT avg(num_revisions) FROM imp) AS mean_after
UNION ALL SELECT 'emp_rate', (SELECT (count(*) - count(emp_rate)) * 100.0 / count(*) FROM raw),
  (SELECT (count(*) - count(emp_rate)) * 100.0 / count(*) FROM imp), (SELECT avg(emp_rate) FROM raw), (SELECT avg(emp_rate) FROM imp)""")
def imp_impact(spark, sf):
    """Imputation impact: null % and mean before / after."""
    raw = _imp_input(roles(spark, sf))
    imp = enc.fill_mean(enc.fill_zero(raw, ["num_revisions"]), ["emp_rate"])
    cols = ["num_revisions", "emp_rate"]

    def prof(d, tag):
        return d.agg(*[((F.count(F.lit(1)) - F.count(c)) * 100.0 / F.count(F.lit(1))).alias(f"{c}|null_pct_{tag}")
                       for c in cols], *[F.avg(c).alias(f"{c}|mean_{tag}") for c in cols])
    one = prof(raw, "before").crossJoin(prof(imp, "after"))
    return ag._stack(one, cols, ["null_pct_before", "null_pct_after", "mean_before", "mean_after"])


def _qcut_sql(col, q, src, clip_=True):
    probs = ", ".join(str(i / q) for i in range(q + 1))
    x = f"CAST({col} AS DOUBLE)"
    if clip_:
        xx = f"least(greatest({x}, (SELECT quantile_cont({x}, 0.02) FROM {src})), (SELECT quantile_cont({x}, 0.98) FROM {src}))"
    else:
        xx = x
    return f"""qx AS (SELECT *, {xx} AS _x FROM {src}),
qe AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(_x, [{probs}]), lambda v: round(v, 9)))) AS e FROM qx),
qb AS (SELECT qx.*, greatest(len(list_filter(e, lambda v: v < round(_x, 9))) - 1, 0) AS bucket, e FROM qx, qe)"""


@register("bin_quantile_rate", round_cols=("bucket_lo", "bucket_hi", "overdue_rate"), oracle=feat_with(
    ", " + _qcut_sql("planned_duration", 10, "feat") + """
SELECT CAST(bucket AS INT) AS bucket, e[bucket + 1] AS bucket_lo, e[bucket + 2] AS bucket_hi, count(*) AS num_tasks,
  avg(calculated_overdue) AS overdue_rate FROM qb GROUP BY bucket, e""", "halfway"))
def bin_quantile_rate(spark, sf):
    """Decile bins (qcut, duplicate edges dropped) after 2/98 % winsorising -> rate."""
    f = _feat(spark, sf, "halfway")
    b = enc.qcut(f, "planned_duration", 10, clip=(0.02, 0.98))
    return b.groupBy(F.col("bucket").cast("int").alias("bucket"), "bucket_lo", "bucket_hi").agg(
        F.count(F.lit(1)).alias("num_tasks"), F.avg("calculated_overdue").alias("overdue_rate"))


@register("an_priority_rates", round_cols=("overdue_rate",), oracle=B + """SELECT
  CASE WHEN weight_level = 'high' THEN 'High' WHEN weight_level = 'mid' THEN 'Mid' ELSE 'Low' END AS priority,
  count(*) AS num_tasks, avg(calculated_overdue) AS overdue_rate FROM base GROUP BY 1""")
def an_priority_rates(spark, sf):
    """One-hot weight levels collapsed back to Low / Mid / High -> rate."""
    b = enc.one_hot(_lbase(roles(spark, sf)), "weight_level", ["high", "mid", "low"], "wl")
    pr = F.when(F.col("wl_high") == 1, "High").when(F.col("wl_mid") == 1, "Mid").otherwise("Low")
    return b.groupBy(pr.alias("priority")).agg(F.count(F.lit(1)).alias("num_tasks"),
                                               F.avg("calculated_overdue").alias("overdue_rate"))


@register("fn_temporal", oracle=f"""SELECT id, CAST(end_date - start_date AS BIGINT) AS planned_duration,
  CAST(floor((epoch_us(CAST(start_date AS TIMESTAMP)) - epoch_us(created_date)) / 86400000000.0) AS BIGINT) AS creation_to_planned_start,
  CAST(floor((epoch_us(CAST({AS_OF_SQL} AS TIMESTAMP)) - epoch_us(updated_date)) / 86400000000.0) AS BIGINT) AS days_since_update,
  CAST(isodow(created_date) - 1 AS INT) AS created_dow, CAST(isodow(created_date) - 1 >= 5 AS INT) AS created_is_weekend,
  CAST(isodow(created_date) - 1 = 4 AS INT) AS created_is_friday, CAST(month(created_date) AS INT) AS created_month,
  CAST(quarter(created_date) AS INT) AS created_quarter, CAST(created_date AS DATE) AS created_day FROM task""")
def fn_temporal(spark, sf):
    """Day differences (floored), Monday=0 calendar parts, truncation to date."""
    t = roles(spark, sf).task
    return t.select("id", date_days("end_date", "start_date").alias("planned_duration"),
                    floor_days("start_date", "created_date").alias("creation_to_planned_start"),
                    floor_days(lit_date(AS_OF), "updated_date").alias("days_since_update"),
                    *calendar_parts("created_date"), F.to_date("created_date").alias("created_day"))


_DW_SQL = f"""WITH x AS (SELECT
  CAST(floor((epoch_us(CAST(start_date AS TIMESTAMP)) - epoch_us(created_date)) / 86400000000.0) AS DOUBLE) AS decision_window,
  CASE WHEN status NOT IN ('completed','terminated','archived') AND end_date < {AS_OF_SQL} THEN CAST({AS_OF_SQL} - end_date AS DOUBLE) END AS days_past_end,
  CASE WHEN status = 'completed' AND actual_end_date IS NOT NULL THEN CAST(actual_end_date - end_date AS DOUBLE) END AS completion_delay
  FROM task WHERE start_date IS NOT NULL AND end_date IS NOT NULL)
"""


@register("fn_decision_window", round_cols=("mean", "std", "min", "p25", "p50", "p75", "max"), oracle=_DW_SQL + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min,
  quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM x"""
    for c in ("decision_window", "days_past_end", "completion_delay")))
def fn_decision_window(spark, sf):
    """Decision window (creation -> planned start), days past end for open
    overdue tasks, completion delay; described (F4)."""
    t = cut.dated(roles(spark, sf).task)
    st, ed = F.col("status"), F.col("end_date")
    x = t.select(
        floor_days("start_date", "created_date").cast("double").alias("decision_window"),
        F.when(~st.isin("completed", "terminated", "archived") & (ed < lit_date(AS_OF)),
               F.datediff(lit_date(AS_OF), ed).cast("double")).alias("days_past_end"),
        F.when((st == "completed") & F.col("actual_end_date").isNotNull(),
               F.datediff("actual_end_date", "end_date").cast("double")).alias("completion_delay"))
    return ag.describe(x, ["decision_window", "days_past_end", "completion_delay"])


@register("fn_clipped_ratio", round_cols=("kpi_achievement",), oracle="""SELECT t.id, ma.kpi_id,
  CASE WHEN k.planned_kpi > 0 THEN least(greatest(k.achieved_kpi / k.planned_kpi, 0.0), 2.0) END AS kpi_achievement
FROM task t LEFT JOIN major_activity ma ON ma.id = t.major_activity_id LEFT JOIN kpi k ON k.id = ma.kpi_id""")
def fn_clipped_ratio(spark, sf):
    """KPI achievement ratio clipped to [0, 2], NULL when planned <= 0, per task."""
    r = roles(spark, sf)
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    k = r.kpi.select(F.col("id").alias("_kid"), "planned_kpi", "achieved_kpi")
    j = r.task.join(ma, F.col("major_activity_id") == F.col("_maid"), "left").join(k, F.col("kpi_id") == F.col("_kid"), "left")
    return j.select("id", "kpi_id", clipped_ratio("achieved_kpi", "planned_kpi").alias("kpi_achievement"))


_HALF_DROP = ml.HALFWAY_DROP


def _halfway_cols():
    from .oracle_wide import DUAL, STATIC
    cols = [c.strip() for c in STATIC.split(",")] + list(DUAL) + ["days_since_update", "subtask_completion_pct_at_halfway"]
    return [c for c in cols if c not in _HALF_DROP]


@register("feat_preprocess", round_cols=("dept_past_overdue_rate", "dept_avg_revisions", "emp_past_overdue_rate",
                                         "pos_past_overdue_rate", "revision_frequency", "avg_sub_status_changes",
                                         "subtask_completion_pct_at_halfway", "duration_revision_intensity"),
          oracle=feat_with("SELECT " + ", ".join(
              {"planned_duration": "greatest(planned_duration, 0) AS planned_duration",
               "num_ma_revisions": "least(num_ma_revisions, 78) AS num_ma_revisions",
               "num_revisions": "least(num_revisions, 9) AS num_revisions"}.get(c, c) for c in _halfway_cols())
              + ", least(num_revisions, 9) / (greatest(planned_duration, 0) + 1) AS duration_revision_intensity FROM feat", "halfway"))
def feat_preprocess(spark, sf):
    """Halfway model preprocessor: clip duration >= 0, parent revisions <= 78,
    revisions <= 9, intensity ratio, drop leaky / id columns (P16, P18, F8)."""
    return ml.preprocess_halfway(_feat(spark, sf, "halfway")).drop("id")


@register("feat_cap_p99", oracle=feat_with("""SELECT id, num_ma_revisions, CAST(cap AS DOUBLE) AS cap_p99,
  CAST(least(num_ma_revisions, cap) AS DOUBLE) AS num_ma_revisions_capped
FROM feat CROSS JOIN (SELECT quantile_cont(num_ma_revisions, 0.99) AS cap FROM feat)""", "halfway"))
def feat_cap_p99(spark, sf):
    """Quantile cap at the 99th percentile, found by narrowing intervals."""
    f = _feat(spark, sf, "halfway")
    (cap,) = exact_quantiles(f, ["num_ma_revisions"], [0.99])["num_ma_revisions"]
    return (f.select("id", "num_ma_revisions", F.lit(cap).cast("double").alias("cap_p99"))
            .withColumn("num_ma_revisions_capped", F.least(F.col("num_ma_revisions").cast("double"), F.col("cap_p99"))))


@register("an_challenge_load", round_cols=("overdue_rate", "overdue_pct"), oracle=feat_with(f""", {CHALLENGE_SQL},
fjc AS (SELECT f.calculated_overdue, c.* FROM feat f LEFT JOIN chal c ON c.cid = f.id)
SELECT 'total_challenge_load' AS dimension, CAST(has_challenges + has_kpi_challenge + has_subtask_challenge + has_kpi_potential_challenge AS BIGINT) AS value,
  count(*) AS num_tasks, avg(calculated_overdue) AS overdue_rate, avg(calculated_overdue) * 100 AS overdue_pct FROM fjc GROUP BY 1, 2
UNION ALL SELECT 'num_challenges', CAST(num_challenges AS BIGINT), count(*), avg(calculated_overdue), avg(calculated_overdue) * 100 FROM fjc GROUP BY 1, 2""", "halfway"))
def an_challenge_load(spark, sf):
    """Composite challenge load (sum of flags) and challenge count -> rate."""
    f = _feat_chal(spark, sf)
    load = (F.col("has_challenges") + F.col("has_kpi_challenge") + F.col("has_subtask_challenge")
            + F.col("has_kpi_potential_challenge"))
    x = f.select(F.explode(F.array(
        F.struct(F.lit("total_challenge_load").alias("dimension"), load.cast("bigint").alias("value")),
        F.struct(F.lit("num_challenges").alias("dimension"), F.col("num_challenges").cast("bigint").alias("value"))))
        .alias("_d"), "calculated_overdue").select("_d.*", "calculated_overdue")
    return x.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("num_tasks"),
                                               F.avg("calculated_overdue").alias("overdue_rate"),
                                               (F.avg("calculated_overdue") * 100).alias("overdue_pct"))


_RULES_SQL = """CAST(num_revisions >= 3 AND has_challenges = 1 AS INT) AS rule_challenged_churn,
  CAST(kpi_is_overdue_flag = 1 AND is_cross_dept = 1 AS INT) AS rule_overdue_kpi_cross_dept,
  CAST(has_subtasks = 0 AND planned_duration > 14 AND num_revisions >= 2 AS INT) AS rule_unstructured_long,
  CAST(creation_to_planned_start < 0 AND num_revisions >= 3 AS INT) AS rule_retroactive_churn"""


def _rules(f):
    c = F.col
    return f.select("id", "calculated_overdue",
                    ((c("num_revisions") >= 3) & (c("has_challenges") == 1)).cast("int").alias("rule_challenged_churn"),
                    ((c("kpi_is_overdue_flag") == 1) & (c("is_cross_dept") == 1)).cast("int").alias("rule_overdue_kpi_cross_dept"),
                    ((c("has_subtasks") == 0) & (c("planned_duration") > 14) & (c("num_revisions") >= 2)).cast("int")
                    .alias("rule_unstructured_long"),
                    ((c("creation_to_planned_start") < 0) & (c("num_revisions") >= 3)).cast("int").alias("rule_retroactive_churn"))


@register("feat_personas", oracle=feat_with(f""", {CHALLENGE_SQL},
fjc AS (SELECT f.*, c.* FROM feat f LEFT JOIN chal c ON c.cid = f.id)
SELECT id, calculated_overdue, {_RULES_SQL} FROM fjc""", "halfway"))
def feat_personas(spark, sf):
    """Persona rules as 0/1 interaction features (P20)."""
    return _rules(_feat_chal(spark, sf))


@register("an_risk_personas", round_cols=("overdue_rate", "overdue_pct", "lift_over_baseline"), oracle=feat_with(f""", {CHALLENGE_SQL},
fjc AS (SELECT f.*, c.* FROM feat f LEFT JOIN chal c ON c.cid = f.id),
rl AS (SELECT id, calculated_overdue, {_RULES_SQL} FROM fjc),
g AS (SELECT calculated_overdue, CASE WHEN rule_challenged_churn = 1 THEN 'Challenged Churn (Critical)'
  WHEN rule_retroactive_churn = 1 THEN 'Retroactive Churn' WHEN rule_overdue_kpi_cross_dept = 1 THEN 'Overdue KPI Cross-Dept'
  WHEN rule_unstructured_long = 1 THEN 'Unstructured Long Task' ELSE 'Baseline / Low Risk' END AS risk_group FROM rl)
SELECT risk_group, count(*) AS num_tasks, avg(calculated_overdue) AS overdue_rate, avg(calculated_overdue) * 100 AS overdue_pct,
  avg(calculated_overdue) / (SELECT avg(calculated_overdue) FROM g) AS lift_over_baseline FROM g GROUP BY 1""", "halfway"))
def an_risk_personas(spark, sf):
    """Rule cohorts with override priority (later rule wins) and lift over the
    baseline rate (1-row aggregate, broadcast) (P21, D15)."""
    rl = _rules(_feat_chal(spark, sf))
    grp = (F.when(F.col("rule_challenged_churn") == 1, "Challenged Churn (Critical)")
           .when(F.col("rule_retroactive_churn") == 1, "Retroactive Churn")
           .when(F.col("rule_overdue_kpi_cross_dept") == 1, "Overdue KPI Cross-Dept")
           .when(F.col("rule_unstructured_long") == 1, "Unstructured Long Task").otherwise("Baseline / Low Risk"))
    base = rl.agg(F.avg("calculated_overdue").alias("_b"))
    g = rl.groupBy(grp.alias("risk_group")).agg(F.count(F.lit(1)).alias("num_tasks"),
                                                F.avg("calculated_overdue").alias("overdue_rate"))
    return (g.crossJoin(F.broadcast(base)).select(
        "risk_group", "num_tasks", "overdue_rate", (F.col("overdue_rate") * 100).alias("overdue_pct"),
        (F.col("overdue_rate") / F.col("_b")).alias("lift_over_baseline")))


@register("ord_topk", oracle=feat_with("""SELECT id, num_revisions, num_subtasks FROM feat
ORDER BY num_revisions DESC, id LIMIT 10""", "halfway"))
def ord_topk(spark, sf):
    """Top-k rows by value with a deterministic tie-break (TakeOrderedAndProject)."""
    f = _feat(spark, sf, "halfway")
    return f.orderBy(F.col("num_revisions").desc(), "id").limit(10).select("id", "num_revisions", "num_subtasks")


@register("ord_min_support", round_cols=("emp_rate",), oracle=f"""WITH t2 AS (SELECT t.*, p.user_id AS uid, {TWO_TIER} AS y
  FROM task t JOIN position p ON p.id = t.position_id WHERE p.user_id IS NOT NULL)
SELECT uid AS assignee_id, count(*) AS n_tasks, avg(y) AS emp_rate FROM t2 GROUP BY 1 HAVING count(*) >= 50
ORDER BY emp_rate DESC, assignee_id""")
def ord_min_support(spark, sf):
    """Minimum-support filter (>= 50 tasks) then rank by rate (O3)."""
    r = roles(spark, sf)
    p = r.position.select(F.col("id").alias("_pid"), F.col("user_id").alias("assignee_id"))
    t = r.task.join(p, F.col("position_id") == F.col("_pid")).filter(F.col("assignee_id").isNotNull())
    g = t.groupBy("assignee_id").agg(F.count(F.lit(1)).alias("n_tasks"), F.avg(lbl.two_tier()).alias("emp_rate"))
    return g.filter(F.col("n_tasks") >= 50).orderBy(F.col("emp_rate").desc(), "assignee_id")


# Days left until an upstream end date; both ends are open.
_DAYS_EDGES = (-INF, -1, 0, 30, 90, 180, 365, INF)
_DAYS_LABELS = ("Past due", "Due today", "< 30 days", "30-90", "90-180", "180-365", "365+")
_case = bin_case_sql


@register("an_days_remaining", round_cols=("overdue_rate",), oracle=B + f""", x AS (SELECT b.calculated_overdue,
  CAST(m.end_date - {AS_OF_SQL} AS BIGINT) AS ms_days FROM base b JOIN major_activity ma ON ma.id = b.major_activity_id
  JOIN kpi k ON k.id = ma.kpi_id JOIN milestone m ON m.id = k.milestone_id)
SELECT {_case('ms_days', _DAYS_EDGES, _DAYS_LABELS)} AS ms_days_bin, {_case('ms_days', _DAYS_EDGES, _DAYS_LABELS, True)} AS bin_order,
  count(*) AS num_tasks, avg(calculated_overdue) AS overdue_rate FROM x WHERE {_case('ms_days', _DAYS_EDGES, _DAYS_LABELS)} IS NOT NULL GROUP BY 1, 2""")
def an_days_remaining(spark, sf):
    """Milestone days-remaining bins against the as-of date -> rate."""
    r = roles(spark, sf)
    b = _lbase(r)
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    k = r.kpi.select(F.col("id").alias("_kid"), "milestone_id")
    m = r.milestone.select(F.col("id").alias("_mid"), F.col("end_date").alias("_mend"))
    x = (b.join(ma, F.col("major_activity_id") == F.col("_maid")).join(k, F.col("kpi_id") == F.col("_kid"))
         .join(m, F.col("milestone_id") == F.col("_mid"))
         .select("calculated_overdue", F.datediff("_mend", lit_date(AS_OF)).alias("ms_days")))
    x = x.select("calculated_overdue", right_closed_bin("ms_days", _DAYS_EDGES, _DAYS_LABELS).alias("ms_days_bin"),
                 bin_index("ms_days", _DAYS_EDGES).alias("bin_order")).filter(F.col("ms_days_bin").isNotNull())
    return x.groupBy("ms_days_bin", "bin_order").agg(F.count(F.lit(1)).alias("num_tasks"),
                                                     F.avg("calculated_overdue").alias("overdue_rate"))


@register("an_upstream_rates", round_cols=("overdue_rate",), oracle=B + """, x AS (SELECT b.id, b.calculated_overdue, k.milestone_id, m.ksi_id, k.goal_id
  FROM base b LEFT JOIN major_activity ma ON ma.id = b.major_activity_id LEFT JOIN kpi k ON k.id = ma.kpi_id
  LEFT JOIN milestone m ON m.id = k.milestone_id)
SELECT 'milestone' AS dimension, CAST(milestone_id AS BIGINT) AS value, count(*) AS num_tasks, avg(calculated_overdue) AS overdue_rate FROM x WHERE milestone_id IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'ksi', CAST(ksi_id AS BIGINT), count(*), avg(calculated_overdue) FROM x WHERE ksi_id IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'goal', CAST(goal_id AS BIGINT), count(*), avg(calculated_overdue) FROM x WHERE goal_id IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT 'pillar', CAST(gp.pillar_id AS BIGINT), count(*), avg(calculated_overdue) FROM x JOIN goal_pillar gp ON gp.goal_id = x.goal_id GROUP BY 1, 2""")
def an_upstream_rates(spark, sf):
    """Upstream segment rates (milestone, KSI, goal, pillar via the bridge), NULL keys dropped.
    One long-form aggregate: each task row is expanded to its (dimension, value) pairs."""
    r = roles(spark, sf)
    b = _lbase(r)
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    k = r.kpi.select(F.col("id").alias("_kid"), "milestone_id", "goal_id")
    m = r.milestone.select(F.col("id").alias("_mid"), "ksi_id")
    x = (b.join(ma, F.col("major_activity_id") == F.col("_maid"), "left").join(k, F.col("kpi_id") == F.col("_kid"), "left")
         .join(m, F.col("milestone_id") == F.col("_mid"), "left"))
    dims = F.array(F.struct(F.lit("milestone").alias("dimension"), F.col("milestone_id").cast("bigint").alias("value")),
                   F.struct(F.lit("ksi").alias("dimension"), F.col("ksi_id").cast("bigint").alias("value")),
                   F.struct(F.lit("goal").alias("dimension"), F.col("goal_id").cast("bigint").alias("value")))
    e = x.select(F.explode(dims).alias("_d"), "calculated_overdue").select("_d.*", "calculated_overdue")
    bridge = r.goal_pillar.select(F.col("goal_id").alias("_gid"), F.col("pillar_id").cast("bigint").alias("value"))
    e = e.unionByName(x.join(bridge, F.col("goal_id") == F.col("_gid")).select(F.lit("pillar").alias("dimension"), "value", "calculated_overdue"))
    return (e.filter(F.col("value").isNotNull()).groupBy("dimension", "value")
            .agg(F.count(F.lit(1)).alias("num_tasks"), F.avg("calculated_overdue").alias("overdue_rate")))


@register("an_score_profile", round_cols=("bucket_lo", "bucket_hi", "overdue_rate"), oracle=feat_with(
    ", " + _qcut_sql("risk_mapping", 10, "feat", clip_=False) + """
SELECT CAST(bucket AS INT) AS bucket, e[bucket + 1] AS bucket_lo, e[bucket + 2] AS bucket_hi, count(*) AS num_tasks,
  avg(calculated_overdue) AS overdue_rate FROM qb WHERE _x IS NOT NULL GROUP BY bucket, e"""))
def an_score_profile(spark, sf):
    """Score-column profile: decile (qcut, duplicates dropped) overdue rate of the risk score."""
    f = _feat(spark, sf)
    b = enc.qcut(f, "risk_mapping", 10).filter(F.col("bucket").isNotNull())
    return b.groupBy(F.col("bucket").cast("int").alias("bucket"), "bucket_lo", "bucket_hi").agg(
        F.count(F.lit(1)).alias("num_tasks"), F.avg("calculated_overdue").alias("overdue_rate"))


@register("an_group_leaderboard", round_cols=("pos_rate", "corr_joined_back"), oracle=B + """, g AS (SELECT position_id, avg(calculated_overdue) AS pos_rate,
  count(*) AS pos_count FROM base WHERE position_id IS NOT NULL GROUP BY 1),
c AS (SELECT corr(CAST(g.pos_rate AS DOUBLE), CAST(b.calculated_overdue AS DOUBLE)) AS corr_joined_back FROM base b JOIN g USING (position_id))
SELECT g.position_id, g.pos_rate, g.pos_count, c.corr_joined_back FROM g CROSS JOIN c
WHERE g.pos_count >= 5 ORDER BY g.pos_rate DESC, g.position_id LIMIT 10""")
def an_group_leaderboard(spark, sf):
    """Group leaderboard: position rate + count joined back, correlation of the
    joined-back rate with the label, top 10 groups with >= 5 tasks (D20)."""
    b = _lbase(roles(spark, sf)).filter(F.col("position_id").isNotNull())
    g = b.groupBy("position_id").agg(F.avg("calculated_overdue").alias("pos_rate"), F.count(F.lit(1)).alias("pos_count"))
    c = b.join(g, "position_id").agg(F.corr(F.col("pos_rate").cast("double"),
                                            F.col("calculated_overdue").cast("double")).alias("corr_joined_back"))
    return (g.filter(F.col("pos_count") >= 5).crossJoin(F.broadcast(c))
            .orderBy(F.col("pos_rate").desc(), "position_id").limit(10))
