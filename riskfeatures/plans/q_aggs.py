"""Registered queries: aggregations (uncut group-bys, profiles, distributions)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import AS_OF, KPI_STATUS_ORDER
from ..functions.scalar import ordinal, safe_ratio
from ..functions.temporal import floor_days, lit_date
from ..operators import aggs as ag
from ..operators import cutoffs as cut
from ..operators import labels as lbl
from ..sources.roles import roles
from . import features as feat
from .catalog import register
from .oracle_wide import CREATION_FEATS, NUMERIC_FEATS, AS_OF_SQL, BASE_CTES, TWO_TIER, feat_with
from .q_analytics import CHALLENGE_SQL, _challenge_flags, _feat

B = f"WITH {BASE_CTES}\n"


@register("agg_revisions", round_cols=("revision_frequency",), oracle=f"""SELECT t.id,
  CAST(coalesce(r.n, 0) AS BIGINT) AS num_revisions, r.last_revision, r.first_revision,
  coalesce(coalesce(r.n, 0) / greatest(CAST(floor((epoch_us(CAST({AS_OF_SQL} AS TIMESTAMP)) - epoch_us(t.created_date)) / 86400000000.0) AS BIGINT), 1), 0) AS revision_frequency,
  CAST(coalesce(floor((epoch_us(CAST({AS_OF_SQL} AS TIMESTAMP)) - epoch_us(r.last_revision)) / 86400000000.0), 0) AS BIGINT) AS revision_recency
FROM task t LEFT JOIN (SELECT history_relation_id AS tid, count(*) AS n, max(history_date) AS last_revision,
  min(history_date) AS first_revision FROM task_history WHERE history_relation_id IS NOT NULL GROUP BY 1) r ON r.tid = t.id""")
def agg_revisions(spark, sf):
    """Uncut revision count, last/first revision, frequency over task age, recency (A1)."""
    r = roles(spark, sf)
    g = (r.task_history.filter(F.col("history_relation_id").isNotNull())
         .groupBy(F.col("history_relation_id").alias("_tid"))
         .agg(F.count(F.lit(1)).alias("_n"), F.max("history_date").alias("last_revision"),
              F.min("history_date").alias("first_revision")))
    j = r.task.join(g, F.col("id") == F.col("_tid"), "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    age = F.greatest(floor_days(lit_date(AS_OF), "created_date"), F.lit(1))
    return j.select("id", n.cast("bigint").alias("num_revisions"), "last_revision", "first_revision",
                    F.coalesce(n / age, F.lit(0.0)).alias("revision_frequency"),
                    F.coalesce(floor_days(lit_date(AS_OF), "last_revision"), F.lit(0)).alias("revision_recency"))


@register("agg_subtasks", round_cols=("subtask_completion_pct", "subtask_overdue_rate"), oracle="""SELECT t.id,
  CAST(coalesce(s.n, 0) AS BIGINT) AS num_subtasks, CAST(coalesce(s.n, 0) > 0 AS INT) AS has_subtasks,
  coalesce(s.c / s.n, 0.0) AS subtask_completion_pct, coalesce(s.o / s.n, 0.0) AS subtask_overdue_rate
FROM task t LEFT JOIN (SELECT task_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS c,
  count(*) FILTER (WHERE is_overdue) AS o FROM sub_task WHERE task_id IS NOT NULL GROUP BY 1) s ON s.task_id = t.id""")
def agg_subtasks(spark, sf):
    """Uncut subtask count, completion / overdue ratios, pre-aggregated then joined."""
    r = roles(spark, sf)
    s = (r.sub_task.filter(F.col("task_id").isNotNull()).groupBy(F.col("task_id").alias("_tid"))
         .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status") == "completed").alias("_c"),
              F.count_if(F.col("is_overdue")).alias("_o")))
    j = r.task.join(s, F.col("id") == F.col("_tid"), "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    return j.select("id", n.cast("bigint").alias("num_subtasks"), (n > 0).cast("int").alias("has_subtasks"),
                    safe_ratio("_c", "_n").alias("subtask_completion_pct"),
                    safe_ratio("_o", "_n").alias("subtask_overdue_rate"))


@register("agg_challenges", oracle=f"WITH {CHALLENGE_SQL}\nSELECT cid AS id, * EXCLUDE (cid) FROM chal")
def agg_challenges(spark, sf):
    """Junction counts + has-flags for task, subtask, KPI and KPI-potential challenges (A3)."""
    return _challenge_flags(roles(spark, sf)).withColumnRenamed("_cid", "id")


@register("agg_challenge_names", oracle="""SELECT tc.task_id, string_agg(DISTINCT cg.challenge_group_name, ', ' ORDER BY cg.challenge_group_name) AS challenge_names,
  CAST(max(CASE WHEN cg.id IS NOT NULL THEN 1 ELSE 0 END) AS INT) AS any_named, count(*) AS n_challenges
FROM task_challenge tc LEFT JOIN challenge_group cg ON cg.id = tc.challengegroup_id GROUP BY 1""")
def agg_challenge_names(spark, sf):
    """Rolled-up bridge: sorted distinct names, any-flag, count per task (A4).
    The name set per task is bounded by the challenge-group dimension."""
    r = roles(spark, sf)
    j = r.task_challenge.join(r.challenge_group, F.col("challengegroup_id") == F.col("id"), "left")
    return j.groupBy("task_id").agg(
        F.when(F.size(F.collect_set("challenge_group_name")) > 0,
               F.array_join(F.array_sort(F.collect_set("challenge_group_name")), ", ")).alias("challenge_names"),
        F.max(F.col("id").isNotNull().cast("int")).alias("any_named"),
        F.count(F.lit(1)).alias("n_challenges"))


_GRP_SQL = f"""WITH rc AS (SELECT history_relation_id AS tid, count(*) AS n FROM task_history
  WHERE history_relation_id IS NOT NULL GROUP BY 1),
t2 AS (SELECT t.*, p.department_id AS pdept, p.user_id AS puser, {TWO_TIER} AS lbl, coalesce(rc.n, 0) AS nrev
  FROM task t LEFT JOIN position p ON p.id = t.position_id LEFT JOIN rc ON rc.tid = t.id)
"""


def _grp_input(spark, sf):
    r = roles(spark, sf)
    rc = (r.task_history.filter(F.col("history_relation_id").isNotNull())
          .groupBy(F.col("history_relation_id").alias("_rid")).agg(F.count(F.lit(1)).alias("_n")))
    p = r.position.select(F.col("id").alias("_pid"), F.col("department_id").alias("pdept"),
                          F.col("user_id").alias("puser"))
    return (r.task.join(p, F.col("position_id") == F.col("_pid"), "left")
            .join(rc, F.col("id") == F.col("_rid"), "left")
            .withColumn("lbl", lbl.two_tier()).withColumn("nrev", F.coalesce("_n", F.lit(0))))


@register("agg_group_rate_dept", round_cols=("dept_past_overdue_rate", "dept_avg_revisions"),
          oracle=_GRP_SQL + """SELECT coalesce(pdept, department_id) AS dept_id, count(*) AS dept_task_count,
  avg(lbl) AS dept_past_overdue_rate, avg(nrev) AS dept_avg_revisions FROM t2 GROUP BY 1""")
def agg_group_rate_dept(spark, sf):
    """Whole-history department rate, task count, avg revisions; NULL group kept."""
    t = _grp_input(spark, sf)
    return t.groupBy(F.coalesce("pdept", "department_id").alias("dept_id")).agg(
        F.count(F.lit(1)).alias("dept_task_count"), F.avg("lbl").alias("dept_past_overdue_rate"),
        F.avg("nrev").alias("dept_avg_revisions"))


@register("agg_group_rate_emp", round_cols=("emp_past_overdue_rate",),
          oracle=_GRP_SQL + """SELECT puser AS assignee_id, count(*) AS emp_task_count, avg(lbl) AS emp_past_overdue_rate
FROM t2 WHERE puser IS NOT NULL GROUP BY 1""")
def agg_group_rate_emp(spark, sf):
    """Employee rate via position -> user (join key pre-resolved)."""
    t = _grp_input(spark, sf).filter(F.col("puser").isNotNull())
    return t.groupBy(F.col("puser").alias("assignee_id")).agg(
        F.count(F.lit(1)).alias("emp_task_count"), F.avg("lbl").alias("emp_past_overdue_rate"))


@register("agg_group_rate_pos", round_cols=("pos_past_overdue_rate",),
          oracle=_GRP_SQL + """SELECT position_id, count(*) AS pos_task_count, avg(lbl) AS pos_past_overdue_rate
FROM t2 WHERE position_id IS NOT NULL GROUP BY 1""")
def agg_group_rate_pos(spark, sf):
    """Position rate."""
    t = _grp_input(spark, sf).filter(F.col("position_id").isNotNull())
    return t.groupBy("position_id").agg(F.count(F.lit(1)).alias("pos_task_count"),
                                        F.avg("lbl").alias("pos_past_overdue_rate"))


@register("agg_nested_churn", round_cols=("avg_status_changes",), oracle="""SELECT st.task_id,
  avg(h.nd) AS avg_status_changes, max(h.nd) AS max_status_changes, CAST(sum(h.nrows) AS BIGINT) AS total_history_entries
FROM (SELECT id, count(DISTINCT status) AS nd, count(*) AS nrows FROM sub_task_history GROUP BY 1) h
JOIN sub_task st ON st.id = h.id GROUP BY 1""")
def agg_nested_churn(spark, sf):
    """Distinct statuses per subtask -> mean / max / total entries per task."""
    r = roles(spark, sf)
    h = r.sub_task_history.groupBy(F.col("id").alias("_sid")).agg(
        F.count_distinct("status").alias("nd"), F.count(F.lit(1)).alias("nrows"))
    j = h.join(r.sub_task.select(F.col("id").alias("_id2"), "task_id"), F.col("_sid") == F.col("_id2"))
    return j.groupBy("task_id").agg(F.avg("nd").alias("avg_status_changes"),
                                    F.max("nd").alias("max_status_changes"),
                                    F.sum("nrows").cast("bigint").alias("total_history_entries"))


@register("agg_parent_revisions", oracle="""SELECT t.id, CAST(coalesce(m.n, 0) AS BIGINT) AS num_ma_revisions,
  CAST(coalesce(k.n, 0) AS BIGINT) AS num_kpi_revisions
FROM task t LEFT JOIN major_activity ma ON ma.id = t.major_activity_id
LEFT JOIN (SELECT id, count(*) AS n FROM major_activity_history GROUP BY 1) m ON m.id = t.major_activity_id
LEFT JOIN (SELECT id, count(*) AS n FROM kpi_history GROUP BY 1) k ON k.id = ma.kpi_id""")
def agg_parent_revisions(spark, sf):
    """Uncut parent / grand-parent revision counts per task."""
    r = roles(spark, sf)
    m = r.major_activity_history.groupBy(F.col("id").alias("_m")).agg(F.count(F.lit(1)).alias("_mn"))
    k = r.kpi_history.groupBy(F.col("id").alias("_k")).agg(F.count(F.lit(1)).alias("_kn"))
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    j = (r.task.join(ma, F.col("major_activity_id") == F.col("_maid"), "left")
         .join(m, F.col("major_activity_id") == F.col("_m"), "left")
         .join(k, F.col("kpi_id") == F.col("_k"), "left"))
    return j.select("id", F.coalesce("_mn", F.lit(0)).cast("bigint").alias("num_ma_revisions"),
                    F.coalesce("_kn", F.lit(0)).cast("bigint").alias("num_kpi_revisions"))


@register("agg_resource_types", oracle="""SELECT t.id, count(DISTINCT rt.resourcetype_id) AS n_resource_types
FROM task t JOIN major_activity ma ON ma.id = t.major_activity_id JOIN kpi_resource_type rt ON rt.kpi_id = ma.kpi_id
GROUP BY 1""")
def agg_resource_types(spark, sf):
    """Distinct resource types per task over three hops; KPI side pre-aggregated
    to distinct (kpi, type) before the fan-out join (A11)."""
    r = roles(spark, sf)
    kt = r.kpi_resource_type.groupBy("kpi_id").agg(F.count_distinct("resourcetype_id").alias("n_resource_types"))
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    return (r.task.join(ma, F.col("major_activity_id") == F.col("_maid"))
            .join(kt, "kpi_id").select("id", "n_resource_types"))


@register("agg_string_agg", oracle="""SELECT 'status_distribution' AS check_name, 'INFO' AS status,
  string_agg(coalesce(status, '') || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, status) AS detail
FROM (SELECT status, count(*) AS n FROM task GROUP BY 1)
UNION ALL SELECT 'comment_content_types', 'INFO',
  string_agg('type_id=' || CAST(content_type_id AS VARCHAR) || ': ' || CAST(n AS VARCHAR) || ' rows', ', ' ORDER BY content_type_id)
FROM (SELECT content_type_id, count(*) AS n FROM comment GROUP BY 1)""")
def agg_string_agg(spark, sf):
    """Ordered STRING_AGG distributions: task status and comment content types."""
    r = roles(spark, sf)
    s = ag.string_distribution(r.task, "status", "%s: %s")
    c = ag.string_distribution(r.comment, "content_type_id", "type_id=%s: %s rows", by_count_desc=False)
    return (s.select(F.lit("status_distribution").alias("check_name"), F.lit("INFO").alias("status"), "detail")
            .unionByName(c.select(F.lit("comment_content_types").alias("check_name"),
                                  F.lit("INFO").alias("status"), "detail")))


@register("agg_value_counts", round_cols=("share",), oracle="""SELECT status, count(*) AS n,
  count(*) / sum(count(*)) OVER () AS share FROM task GROUP BY 1""")
def agg_value_counts(spark, sf):
    """Value counts, absolute and normalised (percent-of-total via a global window
    over the already-aggregated counts) (A13, A14)."""
    g = roles(spark, sf).task.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@register("agg_segment_rates", round_cols=("overdue_rate",), oracle=B + """SELECT weight_level, approval_status,
  count(calculated_overdue) AS num_tasks, avg(calculated_overdue) AS overdue_rate FROM base GROUP BY 1, 2""")
def agg_segment_rates(spark, sf):
    """Count and mean label by segment (weight level x approval)."""
    r = roles(spark, sf)
    b = lbl.with_three_tier(cut.base_tasks(r.task), r.task_history)
    return b.groupBy("weight_level", "approval_status").agg(
        F.count("calculated_overdue").alias("num_tasks"), F.avg("calculated_overdue").alias("overdue_rate"))


@register("agg_pivot_rate", round_cols=("Same Day (0d)", "1-7 Days", "8-30 Days", ">30 Days"), oracle=feat_with("""
, x AS (SELECT CASE WHEN num_revisions > -1 AND num_revisions <= 0 THEN '0 Revs' WHEN num_revisions > 0 AND num_revisions <= 2 THEN '1-2 Revs'
  WHEN num_revisions > 2 AND num_revisions <= 5 THEN '3-5 Revs' WHEN num_revisions > 5 THEN '>5 Revs' END AS rev_bin,
  CASE WHEN planned_duration > -1 AND planned_duration <= 0 THEN 'Same Day (0d)' WHEN planned_duration > 0 AND planned_duration <= 7 THEN '1-7 Days'
  WHEN planned_duration > 7 AND planned_duration <= 30 THEN '8-30 Days' WHEN planned_duration > 30 THEN '>30 Days' END AS dur_bin,
  calculated_overdue FROM feat)
SELECT rev_bin, avg(calculated_overdue) FILTER (WHERE dur_bin = 'Same Day (0d)') AS "Same Day (0d)",
  avg(calculated_overdue) FILTER (WHERE dur_bin = '1-7 Days') AS "1-7 Days",
  avg(calculated_overdue) FILTER (WHERE dur_bin = '8-30 Days') AS "8-30 Days",
  avg(calculated_overdue) FILTER (WHERE dur_bin = '>30 Days') AS ">30 Days"
FROM x WHERE rev_bin IS NOT NULL AND dur_bin IS NOT NULL GROUP BY 1""", "halfway"))
def agg_pivot_rate(spark, sf):
    """Pivot mean label: revision bin x duration bin with fixed column order."""
    from ..functions.scalar import INF, right_closed_bin
    f = _feat(spark, sf, "halfway")
    cols_order = ["Same Day (0d)", "1-7 Days", "8-30 Days", ">30 Days"]
    x = f.select(right_closed_bin("num_revisions", (-1, 0, 2, 5, INF), ("0 Revs", "1-2 Revs", "3-5 Revs", ">5 Revs"))
                 .alias("rev_bin"),
                 right_closed_bin("planned_duration", (-1, 0, 7, 30, INF), cols_order).alias("dur_bin"),
                 "calculated_overdue").dropna(subset=["rev_bin", "dur_bin"])
    return x.groupBy("rev_bin").pivot("dur_bin", cols_order).avg("calculated_overdue")


@register("agg_crosstab", oracle=B + """SELECT status, count(*) FILTER (WHERE calculated_overdue = 0) AS "0",
  count(*) FILTER (WHERE calculated_overdue = 1) AS "1" FROM base GROUP BY 1""")
def agg_crosstab(spark, sf):
    """Cross-tab counts status x label."""
    r = roles(spark, sf)
    b = lbl.with_three_tier(cut.base_tasks(r.task), r.task_history)
    return b.groupBy("status").pivot("calculated_overdue", [0, 1]).count().fillna(0, ["0", "1"])


_DESC_COLS = NUMERIC_FEATS


@register("agg_describe", round_cols=("mean", "std", "min", "p25", "p50", "p75", "p90", "p95", "p99", "max"),
          oracle=feat_with(" UNION ALL ".join(
              f"""SELECT '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, CAST(min({c}) AS DOUBLE) AS min,
  quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75,
  quantile_cont({c}, 0.9) AS p90, quantile_cont({c}, 0.95) AS p95, quantile_cont({c}, 0.99) AS p99, CAST(max({c}) AS DOUBLE) AS max FROM feat"""
              for c in _DESC_COLS), "halfway"))
def agg_describe(spark, sf):
    """Describe with custom percentiles 25/50/75/90/95/99 (exact), sample std."""
    return ag.describe(_feat(spark, sf, "halfway"), _DESC_COLS, (0.25, 0.5, 0.75, 0.9, 0.95, 0.99))


_PROF_COLS = ("id", "status", "approval_status", "lead_approval_status", "weight_level", "is_planned", "is_overdue", "risk_mapping",
              "start_date", "end_date", "actual_end_date", "created_date", "updated_date", "major_activity_id",
              "position_id", "department_id", "derived_from_cross_department_assignment_id")


@register("agg_column_profile", round_cols=("null_pct",), oracle="SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count(*) AS n_rows, count({c}) AS non_null, (count(*) - count({c})) * 100.0 / count(*) AS null_pct,
  count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) = 1 AS is_constant, count(DISTINCT {c}) = 2 AS is_binary FROM task"""
    for c in _PROF_COLS) + ")")
def agg_column_profile(spark, sf):
    """Per-column null %, non-null count, exact cardinality, constant / binary flags."""
    p = ag.column_profile(roles(spark, sf).task, _PROF_COLS)
    return p.drop("dtype")


_VAR_COLS = NUMERIC_FEATS


@register("agg_variance", round_cols=("variance",), oracle=feat_with(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, var_samp({c}) AS variance, coalesce(var_samp({c}) < 0.001, true) AS near_zero FROM feat"
    for c in _VAR_COLS), "halfway"))
def agg_variance(spark, sf):
    """Sample variance per feature and near-zero-variance flag."""
    f = _feat(spark, sf, "halfway")
    one = f.agg(*[F.var_samp(F.col(c).cast("double")).alias(f"{c}|variance") for c in _VAR_COLS])
    long = ag._stack(one, _VAR_COLS, ["variance"])
    return long.withColumn("near_zero", F.coalesce(F.col("variance") < 0.001, F.lit(True)))


@register("agg_skew", round_cols=("skew",), oracle=feat_with(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, skewness({c}) AS skew FROM feat" for c in _VAR_COLS), "halfway"))
def agg_skew(spark, sf):
    """Sample-corrected skewness ranking."""
    f = _feat(spark, sf, "halfway")
    one = f.agg(*[ag.corrected_skew(F.col(c).cast("double")).alias(f"{c}|skew") for c in _VAR_COLS])
    return ag._stack(one, _VAR_COLS, ["skew"])


@register("agg_sparsity", round_cols=("pct_zero", "rate_when_nonzero"), oracle=feat_with(" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_zero,
  avg(calculated_overdue) FILTER (WHERE {c} <> 0) AS rate_when_nonzero,
  CASE WHEN avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END) > 0.95 THEN 'DROP (too sparse)'
       WHEN avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END) > 0.8 THEN 'REVIEW' ELSE 'KEEP' END AS verdict FROM feat"""
    for c in _VAR_COLS), "halfway"))
def agg_sparsity(spark, sf):
    """Sparsity (% zero), rate when non-zero and a verdict per feature."""
    f = _feat(spark, sf, "halfway")
    aggs = []
    for c in _VAR_COLS:
        aggs += [F.avg((F.col(c) == 0).cast("double")).alias(f"{c}|z"),
                 F.avg(F.when(F.col(c) != 0, F.col("calculated_overdue"))).alias(f"{c}|rate_when_nonzero")]
    long = ag._stack(f.agg(*aggs), _VAR_COLS, ["z", "rate_when_nonzero"])
    return long.select("feature", (F.col("z") * 100).alias("pct_zero"), "rate_when_nonzero",
                       F.when(F.col("z") > 0.95, "DROP (too sparse)").when(F.col("z") > 0.8, "REVIEW")
                       .otherwise("KEEP").alias("verdict"))


@register("agg_text_stats", round_cols=("null_pct", "mean_length", "unique_ratio", "mean_words"), oracle="""SELECT
  'text' AS column, (count(*) - count(text)) * 100.0 / count(*) AS null_pct, avg(length(text)) AS mean_length,
  count(DISTINCT text) / count(text) AS unique_ratio,
  avg(len(string_split_regex(trim(text), '\\s+'))) AS mean_words FROM text_rows
UNION ALL SELECT 'source', (count(*) - count(source)) * 100.0 / count(*), avg(length(source)),
  count(DISTINCT source) / count(source), avg(len(string_split_regex(trim(source), '\\s+'))) FROM text_rows""")
def agg_text_stats(spark, sf):
    """Text columns over whole texts: null %, mean length, unique ratio, mean word count."""
    t = roles(spark, sf).text_rows

    def st(c):
        x = F.col(c)
        return t.agg(F.lit(c).alias("column"),
                     ((F.count(F.lit(1)) - F.count(x)) * 100.0 / F.count(F.lit(1))).alias("null_pct"),
                     F.avg(F.length(x)).alias("mean_length"),
                     (F.count_distinct(x) / F.count(x)).alias("unique_ratio"),
                     F.avg(F.size(F.split(F.trim(x), r"\s+"))).alias("mean_words"))
    return st("text").unionByName(st("source"))


@register("dq_dataset_health", oracle=feat_with("""SELECT count(*) AS n_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (id) FROM feat)) AS duplicate_rows_ex_id,
  count(*) - count(DISTINCT id) AS duplicate_ids,
  CAST(""" + " + ".join(f"count(*) - count({c})" for c in (*CREATION_FEATS, "id", "calculated_overdue", "target_source")) + """ AS BIGINT) AS total_missing
FROM feat"""))
def dq_dataset_health(spark, sf):
    """Duplicate rows (ignoring id), duplicate ids and missing cells of all columns."""
    f = _feat(spark, sf)
    dup = f.drop("id").distinct().agg(F.count(F.lit(1)).alias("_d"))
    miss = sum((F.count(F.lit(1)) - F.count(c)) for c in f.columns)
    one = f.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("_ids"),
                miss.cast("bigint").alias("total_missing"))
    return one.crossJoin(dup).select("n_rows", (F.col("n_rows") - F.col("_d")).alias("duplicate_rows_ex_id"),
                                     (F.col("n_rows") - F.col("_ids")).alias("duplicate_ids"), "total_missing")


@register("join_two_hop", oracle="""SELECT t.id, ma.kpi_id, CAST(coalesce(CAST(k.is_overdue AS INT), 0) AS INT) AS kpi_is_overdue_flag,
  CAST(CASE WHEN k.status IS NULL THEN 1 ELSE CASE k.status WHEN 'not_started' THEN 0 WHEN 'ongoing' THEN 1 WHEN 'completed' THEN 2
    WHEN 'terminated' THEN 3 WHEN 'archived' THEN 4 ELSE 1 END END AS INT) AS kpi_status_ordinal
FROM task t LEFT JOIN major_activity ma ON ma.id = t.major_activity_id LEFT JOIN kpi k ON k.id = ma.kpi_id""")
def join_two_hop(spark, sf):
    """Current grand-parent flag + ordinal through task -> MA -> KPI."""
    r = roles(spark, sf)
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    k = r.kpi.select(F.col("id").alias("_kid"), F.col("is_overdue").alias("_ko"), F.col("status").alias("_ks"))
    j = (r.task.join(ma, F.col("major_activity_id") == F.col("_maid"), "left")
         .join(k, F.col("kpi_id") == F.col("_kid"), "left"))
    return j.select("id", "kpi_id", F.coalesce(F.col("_ko").cast("int"), F.lit(0)).alias("kpi_is_overdue_flag"),
                    ordinal("_ks", KPI_STATUS_ORDER).alias("kpi_status_ordinal"))


@register("agg_count_of_counts", oracle="""SELECT n_goals, count(*) AS n_ksis FROM (
  SELECT ksi_id, count(*) AS n_goals FROM ksi_goal GROUP BY 1) GROUP BY 1""")
def agg_count_of_counts(spark, sf):
    """Goals per KSI -> distribution."""
    g = roles(spark, sf).ksi_goal.groupBy("ksi_id").agg(F.count(F.lit(1)).alias("n_goals"))
    return g.groupBy("n_goals").agg(F.count(F.lit(1)).alias("n_ksis"))


@register("agg_histogram", round_cols=("bin_lo", "bin_hi"), oracle="""WITH x AS (SELECT CAST(end_date - start_date AS DOUBLE) AS v FROM task
  WHERE end_date IS NOT NULL AND start_date IS NOT NULL),
mm AS (SELECT min(v) AS lo, max(v) AS hi FROM x),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / 30)), 29) END AS INT) AS bin, lo, hi FROM x, mm)
SELECT bin, lo + bin * (hi - lo) / 30 AS bin_lo, lo + (bin + 1) * (hi - lo) / 30 AS bin_hi, count(*) AS count FROM b GROUP BY bin, lo, hi""")
def agg_histogram(spark, sf):
    """Equal-width 30-bin histogram of planned duration."""
    t = cut.dated(roles(spark, sf).task).select(F.datediff("end_date", "start_date").alias("v"))
    return ag.equal_width_hist(t, "v", 30)
