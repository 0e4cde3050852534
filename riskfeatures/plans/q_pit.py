"""Registered queries: point-in-time features, leak audits, invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import APPROVAL_ORDER, AS_OF, CONTENT_TYPE, STATUS_ORDER
from ..functions.scalar import ordinal, safe_ratio
from ..functions.temporal import as_ts, floor_days, lit_date, midpoint_date
from ..operators import cutoffs as cut
from ..operators import labels as lbl
from ..operators import pit
from ..sources.roles import roles
from . import features as feat
from .catalog import register
from .oracle_wide import AS_OF_SQL, BASE_CTES, WIDE_CTES, _ENC_APR, _ENC_STATUS

W = f"WITH {WIDE_CTES}\n"
B = f"WITH {BASE_CTES}\n"


def _base(spark, sf):
    r = roles(spark, sf)
    return r, cut.base_tasks(r.task)


@register("pit_count_revisions", oracle=W + """SELECT b.id,
  coalesce(r.nr_c, 0) AS num_revisions_at_creation, coalesce(r.nr_h, 0) AS num_revisions_at_halfway,
  r.lr_c AS last_revision_at_creation, r.lr_h AS last_revision_at_halfway
FROM base b LEFT JOIN rev r ON r.task_id = b.id""")
def pit_count_revisions(spark, sf):
    """PIT revision count and last revision timestamp at both cutoffs (PT1, PT2, J8)."""
    r, b = _base(spark, sf)
    th = feat.task_history_features(r, b)
    j = b.select("id").join(th, F.col("id") == F.col("_tid"), "left")
    return j.select("id", *[F.coalesce(F.col(f"num_revisions_at_{n}"), F.lit(0)).alias(f"num_revisions_at_{n}")
                            for n, _ in feat.CUTS],
                    *[F.col(f"last_revision_at_{n}") for n, _ in feat.CUTS])


@register("pit_revision_rates", round_cols=("freq_duration", "freq_age", "freq_none"),
          oracle=W + f"""SELECT b.id,
  CASE WHEN b.planned_duration > 0 THEN coalesce(coalesce(r.nr_h, 0) / nullif(b.planned_duration, 0), 0) ELSE 0.0 END AS freq_duration,
  coalesce(r.nr_h, 0) / greatest(CAST(floor((epoch_us(CAST({AS_OF_SQL} AS TIMESTAMP)) - epoch_us(b.created_date)) / 86400000000.0) AS BIGINT), 1) AS freq_age,
  CAST(coalesce(r.nr_h, 0) AS DOUBLE) AS freq_none,
  CAST(CASE WHEN r.lr_h IS NOT NULL THEN {AS_OF_SQL} - CAST(r.lr_h AS DATE) ELSE 0 END AS INT) AS recency_last_revision,
  CAST(CASE WHEN r.task_id IS NOT NULL THEN {AS_OF_SQL} - CAST(b.created_date AS DATE) ELSE 0 END AS INT) AS recency_since_created
FROM base b LEFT JOIN rev r ON r.task_id = b.id""")
def pit_revision_rates(spark, sf):
    """Revision frequency under the three denominators (duration / age / none) and
    both recency rules, at the halfway cutoff (PT3, T4, T5)."""
    r, b = _base(spark, sf)
    th = feat.task_history_features(r, b)
    j = b.join(th, F.col("id") == F.col("_tid"), "left")
    n = F.coalesce(F.col("num_revisions_at_halfway"), F.lit(0))
    age = F.greatest(floor_days(lit_date(AS_OF), "created_date"), F.lit(1))
    return j.select(
        "id",
        F.when(F.col("planned_duration") > 0, safe_ratio(n, "planned_duration")).otherwise(0.0)
        .alias("freq_duration"),
        (n / age).alias("freq_age"),
        n.cast("double").alias("freq_none"),
        F.when(F.col("last_revision_at_halfway").isNotNull(),
               F.datediff(lit_date(AS_OF), F.to_date("last_revision_at_halfway"))).otherwise(0)
        .cast("int").alias("recency_last_revision"),
        F.when(F.col("_tid").isNotNull(), F.datediff(lit_date(AS_OF), F.to_date("created_date")))
        .otherwise(0).cast("int").alias("recency_since_created"))


@register("pit_subtasks", round_cols=("subtask_completion_pct_at_creation", "subtask_completion_pct_at_halfway",
                                      "subtask_overdue_rate_at_creation", "subtask_overdue_rate_at_halfway"),
          oracle=W + """SELECT id, num_subtasks_at_creation, num_subtasks_at_halfway, has_subtasks_at_creation,
  has_subtasks_at_halfway, subtask_completion_pct_at_creation, subtask_completion_pct_at_halfway,
  subtask_overdue_rate_at_creation, subtask_overdue_rate_at_halfway FROM wide""")
def pit_subtasks(spark, sf):
    """PIT child counts, completion and overdue ratios, current-status mode (PT4, A2, F6)."""
    r, b = _base(spark, sf)
    s = feat.subtask_features(r, b)
    j = b.select("id").join(s, F.col("id") == F.col("_tid"), "left")
    cols = ["id"]
    for n, _ in feat.CUTS:
        ns = F.coalesce(F.col(f"num_subtasks_at_{n}"), F.lit(0))
        cols += [ns.cast("int").alias(f"num_subtasks_at_{n}"),
                 (ns > 0).cast("int").alias(f"has_subtasks_at_{n}"),
                 F.when(ns > 0, safe_ratio(f"num_completed_at_{n}", ns)).otherwise(0.0)
                 .alias(f"subtask_completion_pct_at_{n}"),
                 F.when(ns > 0, safe_ratio(f"num_overdue_at_{n}", ns)).otherwise(0.0)
                 .alias(f"subtask_overdue_rate_at_{n}")]
    return j.select(*cols)


def _subtask_latest(r, cutoffs_by_task, cutoff_col: str):
    """Latest history status per subtask as of its parent's cutoff (unique key:
    every subtask has one parent, so join + filtered max_by is linear)."""
    st = r.sub_task.select(F.col("id").alias("_sid"), F.col("task_id").alias("_stid"),
                           F.col("created_date").alias("_screated"), F.col("status").alias("_scur"))
    sth = r.sub_task_history
    c = cutoffs_by_task.select(F.col("id").alias("_cid"), F.col(cutoff_col).alias("_cut"))
    subs = st.join(c, st["_stid"] == c["_cid"])
    latest = (sth.join(subs.select("_sid", "_cut"), sth["id"] == F.col("_sid"))
              .groupBy("_sid").agg(pit.latest_upto(F.struct("status"), "history_date",
                                                    ["history_id"], "_cut").alias("_lh")))
    return subs.join(latest, "_sid", "left")


@register("pit_subtask_halfway_strict", round_cols=("subtask_completion_pct_at_halfway",),
          oracle=B + """, lh AS (
  SELECT sth.id AS sub_task_id, arg_max({'s': sth.status}, (sth.history_date, sth.history_id)) AS lh
  FROM sub_task_history sth JOIN sub_task st ON st.id = sth.id JOIN base b ON b.id = st.task_id
  WHERE sth.history_date <= b.halfway_cutoff GROUP BY 1),
hs AS (
  SELECT st.task_id,
    count(*) FILTER (WHERE st.created_date <= b.halfway_cutoff) AS num_hist,
    count(*) FILTER (WHERE coalesce(lh.lh.s, 'not_completed') = 'completed' AND st.created_date <= b.halfway_cutoff) AS completed_hist
  FROM sub_task st JOIN base b ON b.id = st.task_id LEFT JOIN lh ON lh.sub_task_id = st.id GROUP BY 1)
SELECT b.id, CAST(coalesce(hs.num_hist, 0) AS INT) AS num_subtasks_at_halfway,
  CAST(coalesce(hs.completed_hist, 0) AS INT) AS num_completed_hist,
  coalesce(hs.completed_hist / nullif(hs.num_hist, 0), 0.0) AS subtask_completion_pct_at_halfway
FROM base b LEFT JOIN hs ON hs.task_id = b.id""")
def pit_subtask_halfway_strict(spark, sf):
    """Child completion from history at halfway, no fallback to current status (PT5, T18)."""
    r, b = _base(spark, sf)
    s = _subtask_latest(r, b, "halfway_cutoff")
    vis = F.col("_screated") <= F.col("_cut")
    agg = s.groupBy("_stid").agg(
        F.count_if(vis).alias("_n"),
        F.count_if(vis & (F.coalesce(F.col("_lh")["status"], F.lit("not_completed")) == "completed"))
        .alias("_c"))
    j = b.select("id").join(agg, F.col("id") == F.col("_stid"), "left")
    return j.select("id", F.coalesce("_n", F.lit(0)).cast("int").alias("num_subtasks_at_halfway"),
                    F.coalesce("_c", F.lit(0)).cast("int").alias("num_completed_hist"),
                    safe_ratio("_c", "_n").alias("subtask_completion_pct_at_halfway"))


@register("pit_subtask_halfway_fallback", round_cols=("subtask_completion_pct_at_halfway",),
          oracle="""WITH th AS (
  SELECT id AS task_id, CAST(start_date + CAST((end_date - start_date) // 2 AS INT) AS TIMESTAMP) AS halfway_date
  FROM task WHERE start_date IS NOT NULL AND end_date IS NOT NULL AND start_date <= end_date),
lh AS (
  SELECT sth.id AS sub_task_id, arg_max({'s': sth.status}, (sth.history_date, sth.history_id)) AS lh
  FROM sub_task_history sth JOIN sub_task st ON st.id = sth.id JOIN th ON th.task_id = st.task_id
  WHERE sth.history_date <= th.halfway_date GROUP BY 1)
SELECT st.task_id, CAST(count(*) AS INT) AS num_subtasks_at_halfway,
  CAST(count(*) FILTER (WHERE coalesce(lh.lh.s, st.status) = 'completed') AS INT) AS num_completed_at_halfway,
  count(*) FILTER (WHERE coalesce(lh.lh.s, st.status) = 'completed') / count(*) AS subtask_completion_pct_at_halfway
FROM sub_task st JOIN th ON th.task_id = st.task_id LEFT JOIN lh ON lh.sub_task_id = st.id
WHERE st.created_date <= th.halfway_date GROUP BY 1""")
def pit_subtask_halfway_fallback(spark, sf):
    """Leaky-pipeline halfway completion: uncapped midpoint, valid-range guard,
    history status falling back to current (PT6, P2, T18)."""
    r = roles(spark, sf)
    t = (r.task.filter(F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
                       & (F.col("start_date") <= F.col("end_date")))
         .select("id", as_ts(midpoint_date("start_date", "end_date")).alias("halfway_date")))
    s = _subtask_latest(r, t, "halfway_date").filter(F.col("_screated") <= F.col("_cut"))
    done = F.coalesce(F.col("_lh")["status"], F.col("_scur")) == "completed"
    return s.groupBy(F.col("_stid").alias("task_id")).agg(
        F.count(F.lit(1)).cast("int").alias("num_subtasks_at_halfway"),
        F.count_if(done).cast("int").alias("num_completed_at_halfway"),
        (F.count_if(done) / F.count(F.lit(1))).alias("subtask_completion_pct_at_halfway"))


@register("pit_status_asof", oracle=W + f"""SELECT b.id,
  r.snap_c.s AS status_at_creation, r.snap_h.s AS status_at_halfway,
  r.snap_c.a AS approval_status_at_creation, r.snap_h.a AS approval_status_at_halfway,
  w.status_encoded_at_creation, w.status_encoded_at_halfway,
  w.approval_status_encoded_at_creation, w.approval_status_encoded_at_halfway,
  w.lead_approval_status_encoded_at_creation, w.lead_approval_status_encoded_at_halfway,
  CASE WHEN r.snap_h.s IS NULL THEN 'current' ELSE 'history' END AS halfway_source
FROM base b LEFT JOIN rev r ON r.task_id = b.id JOIN wide w ON w.id = b.id""")
def pit_status_asof(spark, sf):
    """Status / approval / lead snapshot at both cutoffs, fallback to current,
    ordinal-encoded (PT7, J9, J16, E1, T19)."""
    r, b = _base(spark, sf)
    th = feat.task_history_features(r, b)
    j = b.join(th, F.col("id") == F.col("_tid"), "left")
    cols = ["id",
            F.col("_snap_creation")["status"].alias("status_at_creation"),
            F.col("_snap_halfway")["status"].alias("status_at_halfway"),
            F.col("_snap_creation")["approval_status"].alias("approval_status_at_creation"),
            F.col("_snap_halfway")["approval_status"].alias("approval_status_at_halfway")]
    for n, _ in feat.CUTS:
        cols += [feat._enc_asof(f"_snap_{n}", "status", "status", STATUS_ORDER).alias(f"status_encoded_at_{n}"),
                 feat._enc_asof(f"_snap_{n}", "approval_status", "approval_status", APPROVAL_ORDER)
                 .alias(f"approval_status_encoded_at_{n}"),
                 feat._enc_asof(f"_snap_{n}", "lead_approval_status", "lead_approval_status",
                                APPROVAL_ORDER).alias(f"lead_approval_status_encoded_at_{n}")]
    cols.append(F.when(F.col("_snap_halfway")["status"].isNull(), "current").otherwise("history")
                .alias("halfway_source"))
    return j.select(*cols)


def _cut_long_ma(r, b):
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    return (cut.cutoffs_long(b).join(b.select("id", "major_activity_id"), "id")
            .join(ma, F.col("major_activity_id") == F.col("_maid"), "left"))


@register("pit_parent_asof", oracle=W + """, mas AS (
  SELECT bk.id,
    arg_max({'s': h.status, 'a': h.approval_status}, (h.history_date, h.history_id)) FILTER (WHERE h.history_date <= bk.creation_cutoff) AS mc,
    arg_max({'s': h.status, 'a': h.approval_status}, (h.history_date, h.history_id)) FILTER (WHERE h.history_date <= bk.halfway_cutoff) AS mh
  FROM bk JOIN major_activity_history h ON h.id = bk.major_activity_id GROUP BY 1)
SELECT b.id, mas.mc.s AS ma_status_at_creation, mas.mh.s AS ma_status_at_halfway,
  mas.mc.a AS ma_approval_at_creation, mas.mh.a AS ma_approval_at_halfway
FROM base b LEFT JOIN mas ON mas.id = b.id""")
def pit_parent_asof(spark, sf):
    """Parent (major activity) status snapshot from its history, per task cutoff (PT8)."""
    r, b = _base(spark, sf)
    m = feat.shared_key_pit(r.major_activity_history, "id", "history_date", ["history_id"],
                            _cut_long_ma(r, b), "major_activity_id",
                            values=["status", "approval_status"], prefix="ma_")
    j = b.select("id").join(m, F.col("id") == F.col("_tid"), "left")
    return j.select("id", F.col("ma_v_creation")["status"].alias("ma_status_at_creation"),
                    F.col("ma_v_halfway")["status"].alias("ma_status_at_halfway"),
                    F.col("ma_v_creation")["approval_status"].alias("ma_approval_at_creation"),
                    F.col("ma_v_halfway")["approval_status"].alias("ma_approval_at_halfway"))


@register("pit_kpi_asof", oracle=W + """SELECT id, kpi_is_overdue_flag_at_creation, kpi_is_overdue_flag_at_halfway,
  kpi_status_ordinal_at_creation, kpi_status_ordinal_at_halfway FROM wide""")
def pit_kpi_asof(spark, sf):
    """Grand-parent (KPI) overdue flag and status ordinal through two hops, as of
    each task cutoff; NULL -> 0 / -> 1 (PT9, J10)."""
    w = feat.feature_table(spark, sf)
    return w.select("id", "kpi_is_overdue_flag_at_creation", "kpi_is_overdue_flag_at_halfway",
                    "kpi_status_ordinal_at_creation", "kpi_status_ordinal_at_halfway")


@register("pit_count_parent", oracle=W + """SELECT b.id, CAST(coalesce(mar.mr_c, 0) AS BIGINT) AS num_ma_revisions_at_creation,
  CAST(coalesce(mar.mr_h, 0) AS BIGINT) AS num_ma_revisions_at_halfway FROM base b LEFT JOIN mar ON mar.id = b.id""")
def pit_count_parent(spark, sf):
    """Parent revision count per task as of each cutoff (union-scan, PT10)."""
    r, b = _base(spark, sf)
    m = feat.shared_key_pit(r.major_activity_history, "id", "history_date", ["history_id"],
                            _cut_long_ma(r, b), "major_activity_id", prefix="ma_")
    j = b.select("id").join(m, F.col("id") == F.col("_tid"), "left")
    return j.select("id", *[F.coalesce(F.col(f"ma_n_{n}"), F.lit(0)).cast("bigint")
                            .alias(f"num_ma_revisions_at_{n}") for n, _ in feat.CUTS])


@register("pit_count_kpi", oracle=W + """SELECT b.id, CAST(coalesce(kf.kr_c, 0) AS BIGINT) AS num_kpi_revisions_at_creation,
  CAST(coalesce(kf.kr_h, 0) AS BIGINT) AS num_kpi_revisions_at_halfway FROM base b LEFT JOIN kpif kf ON kf.id = b.id""")
def pit_count_kpi(spark, sf):
    """Grand-parent (KPI) revision count per task as of each cutoff — 25 hot keys,
    handled by one range scan of events and cutoffs (PT11, J11)."""
    r, b = _base(spark, sf)
    m = feat.shared_key_pit(r.kpi_history, "id", "history_date", ["history_id", "history_seq"],
                            _cut_long_ma(r, b), "kpi_id", prefix="kpi_")
    j = b.select("id").join(m, F.col("id") == F.col("_tid"), "left")
    return j.select("id", *[F.coalesce(F.col(f"kpi_n_{n}"), F.lit(0)).cast("bigint")
                            .alias(f"num_kpi_revisions_at_{n}") for n, _ in feat.CUTS])


@register("pit_count_comments", oracle=W + """SELECT id, task_comment_count_at_creation, task_comment_count_at_halfway,
  kpi_comment_count_at_creation FROM wide""")
def pit_count_comments(spark, sf):
    """PIT comment counts by entity type: task (24) at both cutoffs, parent (23) at creation (PT12, T16)."""
    w = feat.feature_table(spark, sf)
    return w.select("id", "task_comment_count_at_creation", "task_comment_count_at_halfway",
                    "kpi_comment_count_at_creation")


@register("pit_churn", round_cols=("avg_sub_status_changes_at_creation", "avg_sub_status_changes_at_halfway"),
          oracle=W + """SELECT task_id, ch_c AS avg_sub_status_changes_at_creation, ch_h AS avg_sub_status_changes_at_halfway FROM churn""")
def pit_churn(spark, sf):
    """Average over subtasks of distinct statuses seen as of each cutoff (PT13, first-seen trick)."""
    r, b = _base(spark, sf)
    return feat.subtask_churn(r, b).withColumnRenamed("_tid", "task_id")


@register("pit_first_completed", oracle="""SELECT history_relation_id AS task_id, min(history_date) AS first_completed_ts,
  CAST(min(history_date) AS DATE) AS first_completed_at, count(*) AS n_completed_rows
FROM task_history WHERE status = 'completed' AND history_relation_id IS NOT NULL GROUP BY 1""")
def pit_first_completed(spark, sf):
    """First-event timestamp by predicate (PT14)."""
    th = roles(spark, sf).task_history
    return (th.filter((F.col("status") == "completed") & F.col("history_relation_id").isNotNull())
            .groupBy(F.col("history_relation_id").alias("task_id"))
            .agg(F.min("history_date").alias("first_completed_ts"),
                 F.to_date(F.min("history_date")).alias("first_completed_at"),
                 F.count(F.lit(1)).alias("n_completed_rows")))


_LEAK_SQL = W + """, uncut AS (
  SELECT b.id,
    (SELECT count(*) FROM task_history h WHERE h.history_relation_id = b.id) AS rev_all,
    (SELECT count(*) FROM comment c WHERE c.object_id = b.id AND c.content_type_id = 24) AS com_all,
    (SELECT count(*) FROM sub_task s WHERE s.task_id = b.id) AS sub_all,
    (SELECT count(*) FROM major_activity_history m WHERE m.id = b.major_activity_id) AS ma_all,
    (SELECT count(*) FROM kpi_history k JOIN major_activity a ON a.kpi_id = k.id WHERE a.id = b.major_activity_id) AS kpi_all
  FROM base b),
lk AS (
  SELECT w.id, 'num_revisions' AS feature, u.rev_all - w.num_revisions_at_creation AS leak FROM wide w JOIN uncut u USING (id)
  UNION ALL SELECT w.id, 'task_comment_count', u.com_all - w.task_comment_count_at_creation FROM wide w JOIN uncut u USING (id)
  UNION ALL SELECT w.id, 'num_subtasks', u.sub_all - w.num_subtasks_at_creation FROM wide w JOIN uncut u USING (id)
  UNION ALL SELECT w.id, 'num_ma_revisions', u.ma_all - w.num_ma_revisions_at_creation FROM wide w JOIN uncut u USING (id)
  UNION ALL SELECT w.id, 'num_kpi_revisions', u.kpi_all - w.num_kpi_revisions_at_creation FROM wide w JOIN uncut u USING (id))
"""


@register("leak_quantify", round_cols=("avg_leak",), oracle=_LEAK_SQL + """SELECT feature, count(*) AS n_tasks,
  count(*) FILTER (WHERE leak > 0) AS n_leaked_tasks, CAST(sum(leak) AS BIGINT) AS leaked_rows,
  avg(leak) AS avg_leak, CAST(max(leak) AS BIGINT) AS max_leak FROM lk GROUP BY feature""")
def leak_quantify(spark, sf):
    """Leak quantifier: uncut vs as-of-creation value per feature — leaked tasks,
    rows, average and max (PT15)."""
    return _leak_long(spark, sf).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("leak") > 0).alias("n_leaked_tasks"),
        F.sum("leak").cast("bigint").alias("leaked_rows"), F.avg("leak").alias("avg_leak"),
        F.max("leak").cast("bigint").alias("max_leak"))


@register("leak_top5", oracle=_LEAK_SQL + """SELECT id, CAST(leak AS BIGINT) AS leak FROM lk
WHERE feature = 'num_revisions' ORDER BY leak DESC, id LIMIT 5""")
def leak_top5(spark, sf):
    """Top-5 tasks by leaked revision rows (PT15 top-k; the limit is the feature)."""
    lk = _leak_long(spark, sf).filter(F.col("feature") == "num_revisions")
    return lk.orderBy(F.col("leak").desc(), "id").limit(5).select("id", F.col("leak").cast("bigint"))


def _leak_long(spark, sf):
    r = roles(spark, sf)
    w = feat.feature_table(spark, sf)
    b = cut.base_tasks(r.task).select("id", "major_activity_id")

    def cnt(df, key, name, cond=None):
        d = df.filter(cond) if cond is not None else df
        return d.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias(name))

    u = (b.join(cnt(r.task_history, "history_relation_id", "rev_all"), F.col("id") == F.col("_k"), "left").drop("_k")
         .join(cnt(r.comment, "object_id", "com_all", F.col("content_type_id") == CONTENT_TYPE["task"]),
               F.col("id") == F.col("_k"), "left").drop("_k")
         .join(cnt(r.sub_task, "task_id", "sub_all"), F.col("id") == F.col("_k"), "left").drop("_k")
         .join(cnt(r.major_activity_history, "id", "ma_all"), F.col("major_activity_id") == F.col("_k"), "left").drop("_k")
         .join(r.major_activity.select(F.col("id").alias("_ma"), "kpi_id"), F.col("major_activity_id") == F.col("_ma"), "left").drop("_ma")
         .join(cnt(r.kpi_history, "id", "kpi_all"), F.col("kpi_id") == F.col("_k"), "left").drop("_k", "kpi_id"))
    j = w.join(u, "id")
    z = F.lit(0)
    return j.select("id", F.expr("""stack(5,
        'num_revisions', coalesce(rev_all, 0) - num_revisions_at_creation,
        'task_comment_count', coalesce(com_all, 0) - task_comment_count_at_creation,
        'num_subtasks', coalesce(sub_all, 0) - num_subtasks_at_creation,
        'num_ma_revisions', coalesce(ma_all, 0) - num_ma_revisions_at_creation,
        'num_kpi_revisions', coalesce(kpi_all, 0) - num_kpi_revisions_at_creation)""").alias("feature", "leak")
                    ).withColumn("leak", F.col("leak") + z)


@register("leak_status_drift", oracle=W + """, s AS (
  SELECT b.id, b.status AS cur, r.snap_c.s AS s_c, r.snap_h.s AS s_h FROM base b LEFT JOIN rev r ON r.task_id = b.id)
SELECT count(*) FILTER (WHERE s_c IS NULL) AS null_at_creation,
  count(*) FILTER (WHERE s_h IS NULL) AS null_at_halfway,
  count(*) FILTER (WHERE coalesce(s_c, 'MISSING') IS DISTINCT FROM cur) AS differs_from_current_at_creation,
  count(*) FILTER (WHERE coalesce(s_h, 'MISSING') IS DISTINCT FROM cur) AS differs_from_current_at_halfway,
  count(*) FILTER (WHERE s_c IS DISTINCT FROM s_h) AS changed_between_cutoffs
FROM s""")
def leak_status_drift(spark, sf):
    """Status drift audit with null-safe comparisons (PT16)."""
    r, b = _base(spark, sf)
    th = feat.task_history_features(r, b)
    s = b.join(th, F.col("id") == F.col("_tid"), "left").select(
        F.col("status").alias("cur"), F.col("_snap_creation")["status"].alias("s_c"),
        F.col("_snap_halfway")["status"].alias("s_h"))
    miss = F.lit("MISSING")
    return s.agg(
        F.count_if(F.col("s_c").isNull()).alias("null_at_creation"),
        F.count_if(F.col("s_h").isNull()).alias("null_at_halfway"),
        F.count_if(~F.coalesce("s_c", miss).eqNullSafe(F.col("cur"))).alias("differs_from_current_at_creation"),
        F.count_if(~F.coalesce("s_h", miss).eqNullSafe(F.col("cur"))).alias("differs_from_current_at_halfway"),
        F.count_if(~F.col("s_c").eqNullSafe(F.col("s_h"))).alias("changed_between_cutoffs"))


_INV = (("revisions_zero_at_creation", "num_revisions_at_creation > 0"),
        ("revisions_monotone", "num_revisions_at_halfway < num_revisions_at_creation"),
        ("subtasks_monotone", "num_subtasks_at_halfway < num_subtasks_at_creation"),
        ("comments_monotone", "task_comment_count_at_halfway < task_comment_count_at_creation"),
        ("ma_revisions_monotone", "num_ma_revisions_at_halfway < num_ma_revisions_at_creation"),
        ("kpi_revisions_monotone", "num_kpi_revisions_at_halfway < num_kpi_revisions_at_creation"),
        ("churn_monotone", "avg_sub_status_changes_at_halfway < avg_sub_status_changes_at_creation"),
        ("status_encoded_range", "status_encoded_at_creation NOT IN (0, 1, 2, 3, 4)"))


@register("leak_invariants", oracle=W + ",\n" + ",\n".join(
    [f"i{k} AS (SELECT '{n}' AS check_name, count(*) FILTER (WHERE {c}) AS n_violations FROM wide)"
     for k, (n, c) in enumerate(_INV)]) + """,
ck AS (SELECT id, calculated_overdue FROM wide), hk AS (SELECT id, calculated_overdue FROM wide),
iid AS (SELECT 'same_ids' AS check_name,
  (SELECT count(*) FROM (SELECT id FROM ck EXCEPT ALL SELECT id FROM hk)) + (SELECT count(*) FROM (SELECT id FROM hk EXCEPT ALL SELECT id FROM ck)) AS n_violations),
itg AS (SELECT 'same_target' AS check_name, count(*) FILTER (WHERE ck.calculated_overdue <> hk.calculated_overdue) AS n_violations
  FROM ck JOIN hk USING (id))
SELECT check_name, n_violations, CASE WHEN n_violations = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
""" + " UNION ALL ".join(f"SELECT * FROM i{k}" for k in range(len(_INV))) + """
  UNION ALL SELECT * FROM iid UNION ALL SELECT * FROM itg)""")
def leak_invariants(spark, sf):
    """Leakage invariants between the two checkpoint datasets: zero revisions at
    creation (expected to FAIL on the fixture), monotone features, same ids and
    target (PT17, Q23, U3)."""
    w = feat.feature_table(spark, sf)
    one = w.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in _INV])
    stack = ", ".join(f"'{n}', {n}" for n, _ in _INV)
    inv = one.select(F.expr(f"stack({len(_INV)}, {stack})").alias("check_name", "n_violations"))
    c = feat.checkpoint_dataset(w, "creation").select("id", "calculated_overdue")
    h = feat.checkpoint_dataset(w, "halfway").select("id", "calculated_overdue")
    ids = c.select("id").exceptAll(h.select("id")).unionByName(h.select("id").exceptAll(c.select("id")))
    same_ids = ids.agg(F.count(F.lit(1)).alias("n_violations")).select(
        F.lit("same_ids").alias("check_name"), "n_violations")
    tg = (c.alias("c").join(h.alias("h"), "id")
          .agg(F.count_if(F.col("c.calculated_overdue") != F.col("h.calculated_overdue")).alias("n_violations"))
          .select(F.lit("same_target").alias("check_name"), "n_violations"))
    allc = inv.unionByName(same_ids).unionByName(tg)
    return allc.withColumn("status", F.when(F.col("n_violations") == 0, "PASS").otherwise("FAIL"))
