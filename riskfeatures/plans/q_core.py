"""Registered queries: labels, cutoffs, expanding windows, wide tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF
from ..operators import cutoffs as cut
from ..operators import labels as lbl
from ..sources.roles import roles
from . import features as feat
from .catalog import register
from .oracle_wide import AS_OF_SQL, BASE_CTES, TWO_TIER, WIDE_CTES, checkpoint_cte

WIDE_DOUBLES = ("dept_past_overdue_rate", "dept_avg_revisions", "emp_past_overdue_rate",
                "pos_past_overdue_rate", "revision_frequency_at_creation",
                "revision_frequency_at_halfway", "subtask_completion_pct_at_creation",
                "subtask_completion_pct_at_halfway", "subtask_overdue_rate_at_creation",
                "subtask_overdue_rate_at_halfway", "avg_sub_status_changes_at_creation",
                "avg_sub_status_changes_at_halfway")
CKPT_DOUBLES = ("dept_past_overdue_rate", "dept_avg_revisions", "emp_past_overdue_rate",
                "pos_past_overdue_rate", "revision_frequency", "subtask_completion_pct",
                "subtask_overdue_rate", "avg_sub_status_changes")


# ---------------------------------------------------------------- labels ----
@register("lbl_three_tier", oracle=f"""WITH {BASE_CTES}
SELECT id, first_completed_at,
  coalesce(actual_end_date, first_completed_at, CAST(updated_date AS DATE)) AS completion_date,
  calculated_overdue, target_source FROM base""")
def lbl_three_tier(spark, sf):
    """Three-tier label + provenance for every dated task."""
    r = roles(spark, sf)
    b = lbl.with_three_tier(cut.base_tasks(r.task), r.task_history)
    return b.select("id", "first_completed_at",
                    F.coalesce("actual_end_date", "first_completed_at", F.to_date("updated_date"))
                    .alias("completion_date"), "calculated_overdue", "target_source")


@register("lbl_two_tier", oracle=f"""SELECT id, {TWO_TIER} AS label_2tier FROM task t
WHERE start_date IS NOT NULL AND end_date IS NOT NULL""")
def lbl_two_tier(spark, sf):
    """Two-tier label used inside historical aggregates."""
    t = cut.dated(roles(spark, sf).task)
    return t.select("id", lbl.two_tier().alias("label_2tier"))


@register("lbl_v1", oracle=f"""SELECT id, CAST(CASE
  WHEN status = 'completed' AND actual_end_date > end_date THEN 1
  WHEN status NOT IN ('completed','terminated','archived') AND end_date < {AS_OF_SQL} THEN 1
  ELSE 0 END AS INT) AS label_v1, is_overdue AS stored_is_overdue FROM task""")
def lbl_v1(spark, sf):
    """v1 label without fallbacks, next to the stored flag."""
    t = roles(spark, sf).task
    return t.select("id", lbl.v1_label().alias("label_v1"),
                    F.col("is_overdue").alias("stored_is_overdue"))


@register("lbl_reclass", oracle=f"""WITH {BASE_CTES},
v AS (SELECT b.id, b.status, CAST(CASE
  WHEN status = 'completed' AND actual_end_date > end_date THEN 1
  WHEN status NOT IN ('completed','terminated','archived') AND end_date < {AS_OF_SQL} THEN 1
  ELSE 0 END AS INT) AS old_label, b.calculated_overdue AS new_label FROM base b)
SELECT status,
  CASE WHEN old_label = new_label THEN 'unchanged' WHEN new_label > old_label THEN '0->1' ELSE '1->0' END AS direction,
  count(*) AS n_tasks, round(avg(old_label), 6) AS old_rate, round(avg(new_label), 6) AS new_rate
FROM v GROUP BY 1, 2""")
def lbl_reclass(spark, sf):
    """Label reclassification diff: old (v1) vs new (three-tier) by status and direction (P10)."""
    r = roles(spark, sf)
    b = lbl.with_three_tier(cut.base_tasks(r.task), r.task_history)
    v = b.select("status", lbl.v1_label().alias("old_label"),
                 F.col("calculated_overdue").alias("new_label"))
    d = (F.when(F.col("old_label") == F.col("new_label"), "unchanged")
         .when(F.col("new_label") > F.col("old_label"), "0->1").otherwise("1->0"))
    return v.groupBy("status", d.alias("direction")).agg(
        F.count(F.lit(1)).alias("n_tasks"), F.avg("old_label").alias("old_rate"),
        F.avg("new_label").alias("new_rate"))


@register("lbl_recovery_funnel", oracle="""SELECT
  count(*) FILTER (WHERE status = 'completed') AS n_completed,
  count(*) FILTER (WHERE status = 'completed' AND actual_end_date IS NULL) AS n_missing_actual,
  count(*) FILTER (WHERE status = 'completed' AND actual_end_date IS NULL
                   AND id IN (SELECT history_relation_id FROM task_history WHERE status = 'completed' AND history_relation_id IS NOT NULL)) AS n_recovered,
  count(*) FILTER (WHERE status = 'completed' AND actual_end_date IS NULL
                   AND id NOT IN (SELECT history_relation_id FROM task_history WHERE history_relation_id IS NOT NULL)) AS n_zero_history,
  count(*) FILTER (WHERE status = 'completed' AND actual_end_date IS NULL
                   AND id IN (SELECT history_relation_id FROM task_history WHERE history_relation_id IS NOT NULL)
                   AND id NOT IN (SELECT history_relation_id FROM task_history WHERE status = 'completed' AND history_relation_id IS NOT NULL)) AS n_history_no_completion
FROM task""")
def lbl_recovery_funnel(spark, sf):
    """Completion-recovery funnel via semi/anti joins."""
    r = roles(spark, sf)
    th = r.task_history.filter(F.col("history_relation_id").isNotNull())
    any_h = th.select(F.col("history_relation_id").alias("_hid")).distinct()
    done_h = th.filter(F.col("status") == "completed").select(
        F.col("history_relation_id").alias("_hid")).distinct()
    miss = r.task.filter((F.col("status") == "completed") & F.col("actual_end_date").isNull())
    flagged = (miss.select("id")
               .join(any_h.withColumn("_any", F.lit(1)), F.col("id") == F.col("_hid"), "left").drop("_hid")
               .join(done_h.withColumn("_done", F.lit(1)), F.col("id") == F.col("_hid"), "left"))
    funnel = flagged.agg(
        F.count(F.lit(1)).alias("n_missing_actual"),
        F.count_if(F.col("_done").isNotNull()).alias("n_recovered"),
        F.count_if(F.col("_any").isNull()).alias("n_zero_history"),
        F.count_if(F.col("_any").isNotNull() & F.col("_done").isNull()).alias("n_history_no_completion"))
    ncomp = r.task.agg(F.count_if(F.col("status") == "completed").alias("n_completed"))
    return ncomp.crossJoin(funnel)


@register("lbl_stored_vs_computed", oracle=f"""WITH v AS (SELECT CAST(is_overdue AS INT) AS stored, CAST(CASE
  WHEN status = 'completed' AND actual_end_date > end_date THEN 1
  WHEN status NOT IN ('completed','terminated','archived') AND end_date < {AS_OF_SQL} THEN 1
  ELSE 0 END AS INT) AS computed FROM task)
SELECT stored, count(*) FILTER (WHERE computed = 0) AS computed_0, count(*) FILTER (WHERE computed = 1) AS computed_1,
  round(avg(CASE WHEN stored = computed THEN 1.0 ELSE 0.0 END), 6) AS agreement
FROM v GROUP BY stored""")
def lbl_stored_vs_computed(spark, sf):
    """Stored flag vs computed label confusion with agreement per stored class."""
    t = roles(spark, sf).task
    v = t.select(F.col("is_overdue").cast("int").alias("stored"), lbl.v1_label().alias("computed"))
    return (v.groupBy("stored").agg(
        F.count_if(F.col("computed") == 0).alias("computed_0"),
        F.count_if(F.col("computed") == 1).alias("computed_1"),
        F.avg((F.col("stored") == F.col("computed")).cast("double")).alias("agreement")))


# --------------------------------------------------------------- cutoffs ----
@register("cut_dual", oracle=f"""WITH {BASE_CTES}
SELECT id, creation_cutoff, halfway_cutoff, planned_duration FROM base""")
def cut_dual(spark, sf):
    """Dual cutoffs (creation, halfway = GREATEST(created, midpoint)) after the date guard."""
    b = cut.base_tasks(roles(spark, sf).task)
    return b.select("id", "creation_cutoff", "halfway_cutoff", "planned_duration")


@register("cut_midpoint", oracle="""SELECT id,
  start_date + CAST((end_date - start_date) // 2 AS INT) AS midpoint_date,
  CAST(start_date AS TIMESTAMP) + to_microseconds(CAST(trunc(date_diff('microsecond', CAST(start_date AS TIMESTAMP), CAST(end_date AS TIMESTAMP)) / 2) AS BIGINT)) AS midpoint_ts,
  greatest(CAST(created_date AS TIMESTAMP), CAST(start_date + CAST((end_date - start_date) // 2 AS INT) AS TIMESTAMP)) AS halfway_cutoff
FROM task WHERE start_date IS NOT NULL AND end_date IS NOT NULL""")
def cut_midpoint(spark, sf):
    """Integer-day and fractional-day midpoints."""
    return cut.midpoints(roles(spark, sf).task)


@register("cut_audit", oracle=f"""WITH {BASE_CTES}
SELECT count(*) AS n_tasks,
  count(*) FILTER (WHERE start_date < CAST(created_date AS DATE)) AS n_retroactive,
  round(avg(CASE WHEN start_date < CAST(created_date AS DATE) THEN 1 ELSE 0 END) * 100, 6) AS pct_retroactive,
  count(*) FILTER (WHERE CAST(start_date + CAST((end_date - start_date) // 2 AS INT) AS TIMESTAMP) < created_date) AS n_midpoint_before_creation,
  min(creation_cutoff) AS min_creation_cutoff, max(creation_cutoff) AS max_creation_cutoff,
  min(halfway_cutoff) AS min_halfway_cutoff, max(halfway_cutoff) AS max_halfway_cutoff
FROM base""")
def cut_audit(spark, sf):
    """Cutoff audit: retroactive share, midpoint-before-creation, cutoff ranges (P5)."""
    return cut.cutoff_audit(cut.base_tasks(roles(spark, sf).task))


# ------------------------------------------------------ expanding windows ----
_EXP_SQL = f"""WITH raw_t AS (
  SELECT t.id, t.created_date, t.position_id, coalesce(p.department_id, t.department_id) AS dept_id,
    p.user_id AS assignee_id, {TWO_TIER} AS is_overdue, coalesce(rc.n, 0) AS rev_count
  FROM task t LEFT JOIN position p ON p.id = t.position_id
  LEFT JOIN (SELECT history_relation_id AS tid, count(*) AS n FROM task_history
             WHERE history_relation_id IS NOT NULL GROUP BY 1) rc ON rc.tid = t.id
  WHERE t.start_date IS NOT NULL AND t.end_date IS NOT NULL)
"""


@register("win_expanding_dept", round_cols=("dept_past_overdue_rate", "dept_avg_revisions"),
          oracle=_EXP_SQL + """SELECT id, dept_id,
  avg(is_overdue) OVER w AS dept_past_overdue_rate, avg(rev_count) OVER w AS dept_avg_revisions,
  count(*) OVER w AS dept_prior_tasks
FROM raw_t WINDOW w AS (PARTITION BY dept_id ORDER BY created_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def win_expanding_dept(spark, sf):
    """Self-excluding expanding overdue rate / revisions / prior count per department."""
    from ..operators.windows import expanding_mean
    raw = _expanding_input(spark, sf)
    return expanding_mean(raw, "dept_id", "created_date", "id", ["is_overdue", "rev_count"],
                          ["dept_past_overdue_rate", "dept_avg_revisions"],
                          keep=("id", "dept_id"), with_count="dept_prior_tasks")


@register("win_expanding_emp", round_cols=("emp_past_overdue_rate",),
          oracle=_EXP_SQL + """SELECT id, assignee_id,
  avg(is_overdue) OVER (PARTITION BY assignee_id ORDER BY created_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS emp_past_overdue_rate
FROM raw_t WHERE assignee_id IS NOT NULL""")
def win_expanding_emp(spark, sf):
    """Expanding overdue rate per employee, NULL employees filtered."""
    from ..operators.windows import expanding_mean
    raw = _expanding_input(spark, sf).filter(F.col("assignee_id").isNotNull())
    return expanding_mean(raw, "assignee_id", "created_date", "id", ["is_overdue"],
                          ["emp_past_overdue_rate"], keep=("id", "assignee_id"))


@register("win_expanding_pos", round_cols=("pos_past_overdue_rate",),
          oracle=_EXP_SQL + """SELECT id, position_id,
  avg(is_overdue) OVER (PARTITION BY position_id ORDER BY created_date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pos_past_overdue_rate
FROM raw_t WHERE position_id IS NOT NULL""")
def win_expanding_pos(spark, sf):
    """Expanding overdue rate per position."""
    from ..operators.windows import expanding_mean
    raw = _expanding_input(spark, sf).filter(F.col("position_id").isNotNull())
    return expanding_mean(raw, "position_id", "created_date", "id", ["is_overdue"],
                          ["pos_past_overdue_rate"], keep=("id", "position_id"))


def _expanding_input(spark, sf):
    r = roles(spark, sf)
    t = cut.dated(r.task)
    rc = (r.task_history.filter(F.col("history_relation_id").isNotNull())
          .groupBy(F.col("history_relation_id").alias("_rid")).agg(F.count(F.lit(1)).alias("_nrev")))
    pos = r.position.select(F.col("id").alias("_pid"), F.col("department_id").alias("_pdept"),
                            F.col("user_id").alias("_puser"))
    return (t.join(pos, t["position_id"] == pos["_pid"], "left")
            .join(rc, t["id"] == rc["_rid"], "left")
            .select("id", "created_date", "position_id",
                    F.coalesce("_pdept", "department_id").alias("dept_id"),
                    F.col("_puser").alias("assignee_id"),
                    lbl.two_tier(as_of=AS_OF).alias("is_overdue"),
                    F.coalesce("_nrev", F.lit(0)).alias("rev_count")))


# ------------------------------------------------------------ wide tables ----
@register("feat_leak_free_wide", round_cols=WIDE_DOUBLES, oracle=f"WITH {WIDE_CTES}\nSELECT * FROM wide")
def feat_leak_free_wide(spark, sf):
    """Full leak-free dual-cutoff feature table (PT18, O1); built once per session
    and input folder, written as Parquet, then shared by the analytics queries;
    ordered by id."""
    return feat.feature_table(spark, sf).orderBy("id")


@register("feat_checkpoint_split", round_cols=CKPT_DOUBLES + ("subtask_completion_pct_at_halfway",),
          oracle=f"WITH {WIDE_CTES},\n{checkpoint_cte('halfway')}\nSELECT * FROM feat")
def feat_checkpoint_split(spark, sf):
    """Halfway checkpoint dataset projected from the dual table."""
    return feat.checkpoint_dataset(feat.feature_table(spark, sf), "halfway")


@register("feat_creation_dataset", round_cols=CKPT_DOUBLES,
          oracle=f"WITH {WIDE_CTES},\n{checkpoint_cte('creation')}\nSELECT * FROM feat")
def feat_creation_dataset(spark, sf):
    """Creation checkpoint dataset (36 columns)."""
    return feat.checkpoint_dataset(feat.feature_table(spark, sf), "creation")
