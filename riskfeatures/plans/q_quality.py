"""Registered queries: joins and the data-quality report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF, CONTENT_TYPE
from ..functions.quantiles import exact_quantiles
from ..functions.temporal import lit_date
from ..operators import cutoffs as cut
from ..operators import labels as lbl
from ..operators import quality as dq
from ..operators.aggs import string_distribution
from ..sources.roles import roles
from .catalog import register
from .oracle_wide import AS_OF_SQL, BASE_CTES

B = f"WITH {BASE_CTES}\n"


def _lbase(r):
    return lbl.with_three_tier(cut.base_tasks(r.task), r.task_history)


# ------------------------------------------------------------------ joins ----
@register("join_parent_lookup", oracle="""SELECT t.id, ma.status AS ma_status, ma.approval_status AS ma_approval_status, ma.kpi_id
FROM task t LEFT JOIN major_activity ma ON ma.id = t.major_activity_id""")
def join_parent_lookup(spark, sf):
    """N:1 left enrichment with the parent (J1).  No broadcast hint: the parent
    dimension grows with the data; AQE switches to a broadcast join at run time
    only when the measured size is under spark.sql.adaptive.autoBroadcastJoinThreshold."""
    r = roles(spark, sf)
    ma = r.major_activity.select(F.col("id").alias("_maid"), F.col("status").alias("ma_status"),
                                 F.col("approval_status").alias("ma_approval_status"), "kpi_id")
    return (r.task.join(ma, F.col("major_activity_id") == F.col("_maid"), "left")
            .select("id", "ma_status", "ma_approval_status", "kpi_id"))


@register("join_deep_chain", oracle="""SELECT t.id, ma.kpi_id, k.milestone_id, m.ksi_id, k.goal_id, g.goal_name,
  CAST(m.is_overdue AS INT) AS milestone_is_overdue, m.end_date AS milestone_end_date,
  CAST(ks.is_overdue AS INT) AS ksi_is_overdue, ks.status AS ksi_status
FROM task t LEFT JOIN major_activity ma ON ma.id = t.major_activity_id LEFT JOIN kpi k ON k.id = ma.kpi_id
LEFT JOIN milestone m ON m.id = k.milestone_id LEFT JOIN ksi ks ON ks.id = m.ksi_id LEFT JOIN goal g ON g.id = k.goal_id""")
def join_deep_chain(spark, sf):
    """Deep left-join chain task -> MA -> KPI -> milestone -> KSI, KPI -> goal."""
    r = roles(spark, sf)
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    k = r.kpi.select(F.col("id").alias("_kid"), "milestone_id", "goal_id")
    m = r.milestone.select(F.col("id").alias("_mid"), "ksi_id", F.col("is_overdue").cast("int").alias("milestone_is_overdue"),
                           F.col("end_date").alias("milestone_end_date"))
    ks = r.ksi.select(F.col("id").alias("_ksid"), F.col("is_overdue").cast("int").alias("ksi_is_overdue"),
                      F.col("status").alias("ksi_status"))
    g = r.goal.select(F.col("id").alias("_gid"), "goal_name")
    j = (r.task.join(ma, F.col("major_activity_id") == F.col("_maid"), "left")
         .join(k, F.col("kpi_id") == F.col("_kid"), "left")
         .join(m, F.col("milestone_id") == F.col("_mid"), "left")
         .join(ks, F.col("ksi_id") == F.col("_ksid"), "left")
         .join(g, F.col("goal_id") == F.col("_gid"), "left"))
    return j.select("id", "kpi_id", "milestone_id", "ksi_id", "goal_id", "goal_name", "milestone_is_overdue",
                    "milestone_end_date", "ksi_is_overdue", "ksi_status")


@register("join_bridge", oracle="""SELECT gp.pillar_id, count(*) AS n_task_rows, count(DISTINCT t.id) AS n_tasks
FROM task t JOIN major_activity ma ON ma.id = t.major_activity_id JOIN kpi k ON k.id = ma.kpi_id
JOIN goal_pillar gp ON gp.goal_id = k.goal_id GROUP BY 1""")
def join_bridge(spark, sf):
    """M:N bridge goal <-> pillar with fan-out preserved (rows) and distinct tasks.
    Tasks are first counted per goal (partial aggregate) so the bridge multiplies
    goal totals, not task rows; repeated bridge rows multiply the rows only, and
    distinct tasks per pillar are exact because a task has exactly one goal."""
    r = roles(spark, sf)
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    k = r.kpi.select(F.col("id").alias("_kid"), "goal_id")
    per_goal = (r.task.join(ma, F.col("major_activity_id") == F.col("_maid"))
                .join(k, F.col("kpi_id") == F.col("_kid"))
                .groupBy("goal_id").agg(F.count(F.lit(1)).alias("_n")))
    bridge = r.goal_pillar.groupBy("goal_id", "pillar_id").agg(F.count(F.lit(1)).alias("_m"))
    return (per_goal.join(bridge, "goal_id").groupBy("pillar_id")
            .agg(F.sum(F.col("_n") * F.col("_m")).cast("bigint").alias("n_task_rows"),
                 F.sum("_n").cast("bigint").alias("n_tasks")))


@register("join_exists_flag", oracle="""SELECT t.id, CAST(CASE WHEN t.derived_from_cross_department_assignment_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS is_cross_dept,
  CAST(CASE WHEN t.id IN (SELECT t2.id FROM task t2 JOIN cross_dept_assignment c ON c.id = t2.derived_from_cross_department_assignment_id) THEN 1 ELSE 0 END AS INT) AS cross_dept_pair_exists
FROM task t""")
def join_exists_flag(spark, sf):
    """Existence flag via left-semi matched keys."""
    r = roles(spark, sf)
    hit = (r.task.select("id", "derived_from_cross_department_assignment_id")
           .join(r.cross_dept_assignment.select(F.col("id").alias("_cid")),
                 F.col("derived_from_cross_department_assignment_id") == F.col("_cid"), "left_semi")
           .select(F.col("id").alias("_hid"), F.lit(1).alias("_hit")))
    return (r.task.join(hit, F.col("id") == F.col("_hid"), "left")
            .select("id", F.col("derived_from_cross_department_assignment_id").isNotNull().cast("int").alias("is_cross_dept"),
                    F.coalesce("_hit", F.lit(0)).cast("int").alias("cross_dept_pair_exists")))


@register("join_cascade", round_cols=("pct",), oracle="""WITH d AS (SELECT t.id, coalesce(p.department_id, t.department_id) AS resolved, t.department_id AS tdept, p.department_id AS pdept
  FROM task t LEFT JOIN position p ON p.id = t.position_id)
SELECT 'position' AS level, count(pdept) AS n, count(pdept) * 100.0 / count(*) AS pct FROM d
UNION ALL SELECT 'task', count(tdept), count(tdept) * 100.0 / count(*) FROM d
UNION ALL SELECT 'resolved', count(resolved), count(resolved) * 100.0 / count(*) FROM d
UNION ALL SELECT 'unresolved', count(*) - count(resolved), (count(*) - count(resolved)) * 100.0 / count(*) FROM d""")
def join_cascade(spark, sf):
    """COALESCE resolution cascade and the share resolved at each level."""
    r = roles(spark, sf)
    p = r.position.select(F.col("id").alias("_pid"), F.col("department_id").alias("pdept"))
    d = r.task.join(p, F.col("position_id") == F.col("_pid"), "left").select(
        F.col("department_id").alias("tdept"), "pdept", F.coalesce("pdept", "department_id").alias("resolved"))
    one = d.agg(F.count(F.lit(1)).alias("n"), F.count("pdept").alias("p"), F.count("tdept").alias("t"),
                F.count("resolved").alias("r"))
    long = one.select("n", F.expr("stack(4, 'position', p, 'task', t, 'resolved', r, 'unresolved', n - r)")
                      .alias("level", "cnt"))
    return long.select("level", F.col("cnt").alias("n"), (F.col("cnt") * 100.0 / F.col("n")).alias("pct"))


@register("join_polymorphic", oracle="""WITH c AS (SELECT content_type_id, object_id, count(*) AS n FROM comment GROUP BY 1, 2)
SELECT t.id, CAST(coalesce(ct.n, 0) AS BIGINT) AS task_comment_count, CAST(coalesce(cm.n, 0) AS BIGINT) AS ma_comment_count,
  CAST(coalesce(ck.n, 0) AS BIGINT) AS kpi_comment_count
FROM task t LEFT JOIN major_activity ma ON ma.id = t.major_activity_id
LEFT JOIN c ct ON ct.object_id = t.id AND ct.content_type_id = 24
LEFT JOIN c cm ON cm.object_id = t.major_activity_id AND cm.content_type_id = 23
LEFT JOIN c ck ON ck.object_id = ma.kpi_id AND ck.content_type_id = 22""")
def join_polymorphic(spark, sf):
    """Polymorphic FK: comments grouped by (type, object) once, joined per entity type."""
    r = roles(spark, sf)
    c = r.comment.groupBy("content_type_id", "object_id").agg(F.count(F.lit(1)).alias("n"))

    def typ(t, name):
        return c.filter(F.col("content_type_id") == t).select(F.col("object_id").alias(f"_o{name}"),
                                                             F.col("n").alias(f"_n{name}"))
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    j = (r.task.join(ma, F.col("major_activity_id") == F.col("_maid"), "left")
         .join(typ(CONTENT_TYPE["task"], "t"), F.col("id") == F.col("_ot"), "left")
         .join(typ(CONTENT_TYPE["major_activity"], "m"), F.col("major_activity_id") == F.col("_om"), "left")
         .join(typ(CONTENT_TYPE["kpi"], "k"), F.col("kpi_id") == F.col("_ok"), "left"))
    return j.select("id", F.coalesce("_nt", F.lit(0)).cast("bigint").alias("task_comment_count"),
                    F.coalesce("_nm", F.lit(0)).cast("bigint").alias("ma_comment_count"),
                    F.coalesce("_nk", F.lit(0)).cast("bigint").alias("kpi_comment_count"))


@register("dq_orphans", oracle="""SELECT 'orphan_task_history' AS check_name, count(*) AS orphan_count FROM task_history th
  WHERE th.history_relation_id IS NOT NULL AND th.history_relation_id NOT IN (SELECT id FROM task WHERE id IS NOT NULL)
UNION ALL SELECT 'orphan_subtasks', count(*) FROM sub_task st WHERE st.task_id IS NOT NULL AND st.task_id NOT IN (SELECT id FROM task WHERE id IS NOT NULL)
UNION ALL SELECT 'orphan_challenge_groups', count(*) FROM task_challenge tc WHERE tc.task_id IS NOT NULL AND tc.task_id NOT IN (SELECT id FROM task WHERE id IS NOT NULL)""")
def dq_orphans(spark, sf):
    """Orphan detection with left-anti joins."""
    r = roles(spark, sf)

    def cnt(name, child, key):
        return dq.orphans(child, key, r.task, "id").agg(F.count(F.lit(1)).alias("orphan_count")).select(
            F.lit(name).alias("check_name"), "orphan_count")
    return (cnt("orphan_task_history", r.task_history, "history_relation_id")
            .unionByName(cnt("orphan_subtasks", r.sub_task, "task_id"))
            .unionByName(cnt("orphan_challenge_groups", r.task_challenge, "task_id")))


@register("join_pair_rate", round_cols=("pair_overdue_rate",), oracle=B + """SELECT c.assigning_department_id AS assigning_dept,
  c.assigned_department_id AS assigned_dept, avg(b.calculated_overdue) AS pair_overdue_rate, count(*) AS pair_count
FROM base b JOIN cross_dept_assignment c ON c.id = b.derived_from_cross_department_assignment_id GROUP BY 1, 2""")
def join_pair_rate(spark, sf):
    """Ordered (assigning, assigned) department pair and pair-level rate."""
    r = roles(spark, sf)
    b = _lbase(r)
    c = r.cross_dept_assignment
    j = b.join(c, b["derived_from_cross_department_assignment_id"] == c["id"])
    return j.groupBy(F.col("assigning_department_id").alias("assigning_dept"),
                     F.col("assigned_department_id").alias("assigned_dept")).agg(
        F.avg("calculated_overdue").alias("pair_overdue_rate"), F.count(F.lit(1)).alias("pair_count"))


@register("an_label_fanout_rate", round_cols=("overdue_rate",), oracle=B + """SELECT cg.challenge_group_name,
  count(*) AS num_tasks, avg(b.calculated_overdue) AS overdue_rate
FROM base b JOIN task_challenge tc ON tc.task_id = b.id JOIN challenge_group cg ON cg.id = tc.challengegroup_id GROUP BY 1""")
def an_label_fanout_rate(spark, sf):
    """Inner join fan-out: label rate per challenge name."""
    r = roles(spark, sf)
    b = _lbase(r).select("id", "calculated_overdue")
    j = (b.join(r.task_challenge, b["id"] == F.col("task_id"))
         .join(r.challenge_group, F.col("challengegroup_id") == r.challenge_group["id"]))
    return j.groupBy("challenge_group_name").agg(F.count(F.lit(1)).alias("num_tasks"),
                                                 F.avg("calculated_overdue").alias("overdue_rate"))


@register("join_milestone_proximity", oracle="""SELECT t.id, m.id AS milestone_id, CAST(m.end_date - t.end_date AS BIGINT) AS milestone_proximity
FROM task t JOIN major_activity ma ON ma.id = t.major_activity_id JOIN kpi k ON k.id = ma.kpi_id
LEFT JOIN milestone m ON m.id = k.milestone_id""")
def join_milestone_proximity(spark, sf):
    """Days between milestone end and task end across the 3-hop chain."""
    r = roles(spark, sf)
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    k = r.kpi.select(F.col("id").alias("_kid"), "milestone_id")
    m = r.milestone.select(F.col("id").alias("_mid"), F.col("end_date").alias("_mend"))
    j = (r.task.join(ma, F.col("major_activity_id") == F.col("_maid"))
         .join(k, F.col("kpi_id") == F.col("_kid"))
         .join(m, F.col("milestone_id") == F.col("_mid"), "left"))
    return j.select("id", F.col("_mid").alias("milestone_id"),
                    F.datediff("_mend", "end_date").cast("bigint").alias("milestone_proximity"))


# --------------------------------------------------------------- DQ report ----
def _pct_sql(x):
    return f"format('{{:.1f}}', round({x} * 100, 1))"


_DQ_SQL = f"""WITH tt AS (SELECT
    count(*) AS n, count(*) FILTER (WHERE status IS NULL) AS n_null_status,
    count(*) FILTER (WHERE start_date IS NULL) AS n_null_start, count(*) FILTER (WHERE end_date IS NULL) AS n_null_end,
    count(*) FILTER (WHERE department_id IS NULL AND position_id IS NULL) AS n_null_dept,
    count(*) FILTER (WHERE status = 'completed' AND actual_end_date IS NULL) AS n_done_no_actual,
    count(*) FILTER (WHERE status = 'completed') AS n_done,
    count(*) - count(DISTINCT id) AS dup_ids,
    count(*) FILTER (WHERE start_date IS NOT NULL AND end_date IS NOT NULL AND end_date < start_date) AS n_invalid,
    count(*) FILTER (WHERE created_date > CAST({AS_OF_SQL} AS TIMESTAMP)) AS n_future,
    count(*) FILTER (WHERE start_date IS NOT NULL AND end_date IS NOT NULL) AS n_dated,
    count(*) FILTER (WHERE start_date IS NOT NULL AND end_date IS NOT NULL AND end_date <= start_date) AS n_nonpos,
    count(*) FILTER (WHERE derived_from_cross_department_assignment_id IS NOT NULL) AS n_cross
  FROM task),
kp AS (SELECT count(*) AS n, count(ma.kpi_id) AS resolved FROM task t LEFT JOIN major_activity ma ON ma.id = t.major_activity_id)
SELECT 'row_count_tasks_task' AS check_name, CASE WHEN n = e THEN 'PASS' ELSE 'FAIL' END AS status, 'Expected ' || e || ', got ' || n AS detail FROM tt, (SELECT count(DISTINCT l_orderkey) AS e FROM lineitem)
UNION ALL SELECT 'row_count_basedata_position', CASE WHEN (SELECT count(*) FROM position) > 0 THEN 'PASS' ELSE 'FAIL' END, 'Got ' || (SELECT count(*) FROM position) || ' rows'
UNION ALL SELECT 'null_status', CASE WHEN n_null_status = 0 THEN 'PASS' ELSE 'FAIL' END, 'status is ' || {_pct_sql('n_null_status / n')} || '% null' FROM tt
UNION ALL SELECT 'null_start_date', CASE WHEN n_null_start = 0 THEN 'PASS' ELSE 'WARN' END, 'start_date is ' || {_pct_sql('n_null_start / n')} || '% null (' || n_null_start || ' rows)' FROM tt
UNION ALL SELECT 'null_end_date', CASE WHEN n_null_end = 0 THEN 'PASS' ELSE 'WARN' END, 'end_date is ' || {_pct_sql('n_null_end / n')} || '% null (' || n_null_end || ' rows)' FROM tt
UNION ALL SELECT 'null_department_id', CASE WHEN n_null_dept * 100.0 / n < 10 THEN 'PASS' ELSE 'WARN' END, 'department_id is ' || {_pct_sql('n_null_dept / n')} || '% null (resolved from position)' FROM tt
UNION ALL SELECT 'null_actual_end_date_completed', CASE WHEN coalesce(n_done_no_actual * 100.0 / nullif(n_done, 0), 0) < 5 THEN 'PASS' ELSE 'WARN' END,
  coalesce({_pct_sql('n_done_no_actual / nullif(n_done, 0)')}, 'n/a') || '% of completed tasks have null actual_end_date' FROM tt
UNION ALL SELECT 'dup_task_id', CASE WHEN dup_ids = 0 THEN 'PASS' ELSE 'FAIL' END, 'Found ' || dup_ids || ' duplicate task IDs' FROM tt
UNION ALL SELECT 'dup_subtask_id', CASE WHEN d = 0 THEN 'PASS' ELSE 'FAIL' END, 'Found ' || d || ' duplicate subtask IDs' FROM (SELECT count(*) - count(DISTINCT id) AS d FROM sub_task)
UNION ALL SELECT 'invalid_dates', CASE WHEN n_invalid = 0 THEN 'PASS' ELSE 'WARN' END, n_invalid || ' tasks have end_date < start_date' FROM tt
UNION ALL SELECT 'future_created_dates', CASE WHEN n_future = 0 THEN 'PASS' ELSE 'WARN' END, n_future || ' tasks have created_date in the future' FROM tt
UNION ALL SELECT 'planned_duration_zero_or_negative', CASE WHEN n_nonpos * 100.0 / n_dated < 5 THEN 'PASS' ELSE 'WARN' END, {_pct_sql('n_nonpos / n_dated')} || '% of tasks have planned_duration <= 0' FROM tt
UNION ALL SELECT 'task_history_entries', 'INFO', r || ' total history rows across ' || d || ' tasks' FROM (SELECT count(*) AS r, count(DISTINCT history_relation_id) AS d FROM task_history WHERE history_relation_id IS NOT NULL)
UNION ALL SELECT 'subtask_history_entries', 'INFO', r || ' total history rows across ' || d || ' subtasks' FROM (SELECT count(*) AS r, count(DISTINCT id) AS d FROM sub_task_history WHERE id IS NOT NULL)
UNION ALL SELECT 'cross_dept_coverage', 'INFO', n_cross || ' tasks have cross-dept assignments (' || format('{{:.1f}}', round(n_cross * 100.0 / n, 1)) || '%)' FROM tt
UNION ALL SELECT 'kpi_resolution_rate', 'INFO', resolved || ' tasks resolve to a KPI via MA chain (' || format('{{:.1f}}', round(resolved * 100.0 / n, 1)) || '%)' FROM kp"""


@register("dq_report", oracle=_DQ_SQL)
def dq_report(spark, sf):
    """Fused data-quality report: null / duplicate / range / history / coverage
    checks, one aggregate pass per source table (Q1-Q9, Q13, Q14, Q16-Q18,
    Q20, Q21, U2, F10, T15).  Percent thresholds compare fraction x 100.
    The expected task count is the number of tasks that the detail rows name, "now" a parameter."""
    r = roles(spark, sf)
    named = spark.table("lineitem").agg(F.count_distinct("l_orderkey")).first()[0]
    return dq_report_frame(r, expected_tasks=named, as_of=AS_OF)


def dq_report_frame(r, expected_tasks: int, as_of=AS_OF):
    t = r.task
    c = F.col
    one = t.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("status").isNull()).alias("n_null_status"),
        F.count_if(c("start_date").isNull()).alias("n_null_start"),
        F.count_if(c("end_date").isNull()).alias("n_null_end"),
        F.count_if(c("department_id").isNull() & c("position_id").isNull()).alias("n_null_dept"),
        F.count_if((c("status") == "completed") & c("actual_end_date").isNull()).alias("n_done_no_actual"),
        F.count_if(c("status") == "completed").alias("n_done"),
        (F.count(F.lit(1)) - F.count_distinct("id")).alias("dup_ids"),
        F.count_if(c("start_date").isNotNull() & c("end_date").isNotNull() & (c("end_date") < c("start_date"))).alias("n_invalid"),
        F.count_if(c("created_date") > lit_date(as_of).cast("timestamp_ntz")).alias("n_future"),
        F.count_if(c("start_date").isNotNull() & c("end_date").isNotNull()).alias("n_dated"),
        F.count_if(c("start_date").isNotNull() & c("end_date").isNotNull() & (c("end_date") <= c("start_date"))).alias("n_nonpos"),
        F.count_if(c("derived_from_cross_department_assignment_id").isNotNull()).alias("n_cross"))
    s = lambda x: x.cast("string")
    rows = one.select(F.array(
        F.struct(*dq.row("row_count_tasks_task", dq.status_when(c("n") == expected_tasks),
                         F.concat(F.lit(f"Expected {expected_tasks}, got "), s(c("n"))))),
        F.struct(*dq.row("null_status", dq.status_when(c("n_null_status") == 0),
                         F.concat(F.lit("status is "), dq.pct1(c("n_null_status") / c("n") * 100), F.lit("% null")))),
        F.struct(*dq.row("null_start_date", dq.status_when(c("n_null_start") == 0, "WARN"),
                         F.concat(F.lit("start_date is "), dq.pct1(c("n_null_start") / c("n") * 100),
                                  F.lit("% null ("), s(c("n_null_start")), F.lit(" rows)")))),
        F.struct(*dq.row("null_end_date", dq.status_when(c("n_null_end") == 0, "WARN"),
                         F.concat(F.lit("end_date is "), dq.pct1(c("n_null_end") / c("n") * 100),
                                  F.lit("% null ("), s(c("n_null_end")), F.lit(" rows)")))),
        F.struct(*dq.row("null_department_id", dq.status_when(c("n_null_dept") * 100.0 / c("n") < 10, "WARN"),
                         F.concat(F.lit("department_id is "), dq.pct1(c("n_null_dept") / c("n") * 100),
                                  F.lit("% null (resolved from position)")))),
        F.struct(*dq.row("null_actual_end_date_completed",
                         dq.status_when(F.coalesce(F.try_divide(c("n_done_no_actual") * 100.0, c("n_done")), F.lit(0.0)) < 5, "WARN"),
                         F.concat(F.coalesce(dq.pct1(F.try_divide(c("n_done_no_actual") * 1.0, c("n_done")) * 100), F.lit("n/a")),
                                  F.lit("% of completed tasks have null actual_end_date")))),
        F.struct(*dq.row("dup_task_id", dq.status_when(c("dup_ids") == 0),
                         F.concat(F.lit("Found "), s(c("dup_ids")), F.lit(" duplicate task IDs")))),
        F.struct(*dq.row("invalid_dates", dq.status_when(c("n_invalid") == 0, "WARN"),
                         F.concat(s(c("n_invalid")), F.lit(" tasks have end_date < start_date")))),
        F.struct(*dq.row("future_created_dates", dq.status_when(c("n_future") == 0, "WARN"),
                         F.concat(s(c("n_future")), F.lit(" tasks have created_date in the future")))),
        F.struct(*dq.row("planned_duration_zero_or_negative",
                         dq.status_when(c("n_nonpos") * 100.0 / c("n_dated") < 5, "WARN"),
                         F.concat(dq.pct1(c("n_nonpos") / c("n_dated") * 100), F.lit("% of tasks have planned_duration <= 0")))),
        F.struct(*dq.row("cross_dept_coverage", F.lit("INFO"),
                         F.concat(s(c("n_cross")), F.lit(" tasks have cross-dept assignments ("),
                                  dq.pct1(c("n_cross") * 100.0 / c("n")), F.lit("%)")))),
    ).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    pos = r.position.agg(F.count(F.lit(1)).alias("n")).select(
        *dq.row("row_count_basedata_position", dq.status_when(c("n") > 0),
                F.concat(F.lit("Got "), s(c("n")), F.lit(" rows"))))
    sub = r.sub_task.agg((F.count(F.lit(1)) - F.count_distinct("id")).alias("d")).select(
        *dq.row("dup_subtask_id", dq.status_when(c("d") == 0),
                F.concat(F.lit("Found "), s(c("d")), F.lit(" duplicate subtask IDs"))))
    th = r.task_history.filter(c("history_relation_id").isNotNull()).agg(
        F.count(F.lit(1)).alias("r"), F.count_distinct("history_relation_id").alias("d")).select(
        *dq.row("task_history_entries", F.lit("INFO"),
                F.concat(s(c("r")), F.lit(" total history rows across "), s(c("d")), F.lit(" tasks"))))
    sh = r.sub_task_history.filter(c("id").isNotNull()).agg(
        F.count(F.lit(1)).alias("r"), F.count_distinct("id").alias("d")).select(
        *dq.row("subtask_history_entries", F.lit("INFO"),
                F.concat(s(c("r")), F.lit(" total history rows across "), s(c("d")), F.lit(" subtasks"))))
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    kp = (t.join(ma, c("major_activity_id") == c("_maid"), "left")
          .agg(F.count(F.lit(1)).alias("n"), F.count("kpi_id").alias("k"))
          .select(*dq.row("kpi_resolution_rate", F.lit("INFO"),
                          F.concat(s(c("k")), F.lit(" tasks resolve to a KPI via MA chain ("),
                                   dq.pct1(c("k") * 100.0 / c("n")), F.lit("%)")))))
    return rows.unionByName(pos).unionByName(sub).unionByName(th).unionByName(sh).unionByName(kp)


_P99 = "quantile_cont(planned_duration, 0.99)"


@register("dq_outliers", round_cols=("p99_planned_duration",), oracle=B + f"""SELECT
  count(*) FILTER (WHERE planned_duration < 0) AS negative_durations,
  count(*) FILTER (WHERE creation_to_planned_start < 0) AS negative_creation_to_start,
  CAST({_P99} AS DOUBLE) AS p99_planned_duration,
  count(*) FILTER (WHERE planned_duration > 1000) AS rows_over_1000
FROM base""")
def dq_outliers(spark, sf):
    """Outlier panel: negative durations, p99, rows above 1000 days (Q24)."""
    b = cut.base_tasks(roles(spark, sf).task)
    (p99,) = exact_quantiles(b, ["planned_duration"], [0.99])["planned_duration"]
    return b.agg(F.count_if(F.col("planned_duration") < 0).alias("negative_durations"),
                 F.count_if(F.col("creation_to_planned_start") < 0).alias("negative_creation_to_start"),
                 F.lit(p99).cast("double").alias("p99_planned_duration"),
                 F.count_if(F.col("planned_duration") > 1000).alias("rows_over_1000"))
