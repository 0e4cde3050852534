"""Registered queries: label mismatches, halfway availability, upstream and
activity bins over uncut counts, score columns, summary sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import INF, bin_case_sql, bin_index, right_closed_bin
from ..functions.temporal import lit_date
from ..config import AS_OF
from ..operators import analytics as an
from ..operators import labels as lbl
from ..operators import cutoffs as cut
from ..sources import readers as rd
from ..sources import sinks as sk
from ..sources.roles import roles
from . import features as feat
from .catalog import register
from .oracle_wide import AS_OF_SQL, BASE_CTES, overdue_sql
from .q_current import CUR_DOUBLES, CURRENT_CTES, FEATURES_ADDED_AT_HALFWAY, FEATURES_AT_ASSIGNMENT
from .q_encode import _DAYS_EDGES, _DAYS_LABELS


@register("lbl_mismatch_rows", oracle=f"""WITH v AS (SELECT t.id, t.status, CAST(t.is_overdue AS INT) AS stored,
  {overdue_sql('t', 't.actual_end_date')} AS computed FROM task t)
SELECT id, status, stored, computed, CASE WHEN stored = 1 THEN 'false_positive' ELSE 'false_negative' END AS kind FROM v WHERE stored <> computed""")
def lbl_mismatch_rows(spark, sf):
    """Rows whose stored flag contradicts the computed label."""
    v = roles(spark, sf).task.select("id", "status", F.col("is_overdue").cast("int").alias("stored"), lbl.v1_label().alias("computed"))
    return v.where("stored <> computed").withColumn("kind", F.when(F.col("stored") == 1, "false_positive").otherwise("false_negative"))


_HALFWAY_LIST = tuple(dict.fromkeys((*FEATURES_AT_ASSIGNMENT, *FEATURES_ADDED_AT_HALFWAY)))


@register("feat_availability_halfway", round_cols=tuple(c for c in CUR_DOUBLES if c in _HALFWAY_LIST),
          oracle=f"WITH {CURRENT_CTES}\nSELECT id, calculated_overdue, " + ", ".join(_HALFWAY_LIST) + " FROM current_wide")
def feat_availability_halfway(spark, sf):
    """Availability projection: the features known at halfway."""
    return feat.current_wide(roles(spark, sf), store=feat.stored_by_id).select("id", "calculated_overdue", *_HALFWAY_LIST)


_KSI_DAYS = f"CAST(x.end_date - {AS_OF_SQL} AS BIGINT)"


@register("an_ksi_days_remaining", round_cols=("overdue_rate",), oracle=f"""WITH {BASE_CTES}, e AS (
  SELECT ksi_id, max(end_date) AS end_date FROM milestone GROUP BY 1),
x AS (SELECT b.calculated_overdue, e.end_date FROM base b JOIN major_activity ma ON ma.id = b.major_activity_id
  JOIN kpi k ON k.id = ma.kpi_id JOIN milestone m ON m.id = k.milestone_id JOIN e ON e.ksi_id = m.ksi_id)
SELECT {bin_case_sql(_KSI_DAYS, _DAYS_EDGES, _DAYS_LABELS)} AS ksi_days_bin, {bin_case_sql(_KSI_DAYS, _DAYS_EDGES, _DAYS_LABELS, True)} AS bin_order,
  count(*) AS num_tasks, avg(x.calculated_overdue) AS overdue_rate FROM x GROUP BY 1, 2""")
def an_ksi_days_remaining(spark, sf):
    """Days until the KSI's end (its last milestone's) against the as-of date -> rate."""
    r = roles(spark, sf)
    b = lbl.with_three_tier(cut.base_tasks(r.task), r.task_history)
    ends = r.milestone.groupBy(F.col("ksi_id").alias("_ksi")).agg(F.max("end_date").alias("_end"))
    m = r.milestone.select(F.col("id").alias("_mid"), "ksi_id").join(ends, F.col("ksi_id") == F.col("_ksi"))
    x = (b.join(r.major_activity.select(F.col("id").alias("_maid"), "kpi_id"), F.col("major_activity_id") == F.col("_maid"))
          .join(r.kpi.select(F.col("id").alias("_kid"), "milestone_id"), F.col("kpi_id") == F.col("_kid"))
          .join(m, F.col("milestone_id") == F.col("_mid"))
          .select("calculated_overdue", F.datediff("_end", lit_date(AS_OF)).alias("_days")))
    x = x.select("calculated_overdue", right_closed_bin("_days", _DAYS_EDGES, _DAYS_LABELS).alias("ksi_days_bin"),
                 bin_index("_days", _DAYS_EDGES).alias("bin_order"))
    return x.groupBy("ksi_days_bin", "bin_order").agg(F.count("*").alias("num_tasks"), F.avg("calculated_overdue").alias("overdue_rate"))


# Bins of uncut counts; the outer ends are open.
_CMT = ((-INF, 0, 1, 3, 6, INF), ("0", "1", "2-3", "4-6", "6+"))
_HIST = ((-INF, 0, 1, 3, 5, 10, INF), ("0", "1", "2-3", "4-5", "6-10", "10+"))
_UNCUT = {"kpi_comments": ("kpi_comment_count", *_CMT), "ma_comments": ("ma_comment_count", *_CMT),
          "sub_history_entries": ("total_sub_history_entries", *_HIST)}


@register("an_upstream_activity_bins", round_cols=("overdue_rate", "overdue_rate_pct"), oracle=f"""WITH {BASE_CTES},
cm AS (SELECT content_type_id AS ct, object_id AS o, count(*) AS n FROM comment GROUP BY 1, 2),
sh AS (SELECT st.task_id, count(*) AS n FROM sub_task_history h JOIN sub_task st ON st.id = h.id GROUP BY 1),
x AS (SELECT b.calculated_overdue, coalesce(k.n, 0) AS kpi_comment_count, coalesce(m.n, 0) AS ma_comment_count,
    coalesce(sh.n, 0) AS total_sub_history_entries
  FROM base b LEFT JOIN major_activity ma ON ma.id = b.major_activity_id
  LEFT JOIN cm k ON k.ct = 22 AND k.o = ma.kpi_id LEFT JOIN cm m ON m.ct = 23 AND m.o = b.major_activity_id
  LEFT JOIN sh ON sh.task_id = b.id)
SELECT dimension, bin, bin_order, count(*) AS num_tasks, avg(calculated_overdue) AS overdue_rate, avg(calculated_overdue) * 100 AS overdue_rate_pct
FROM (""" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {bin_case_sql(c, e, l)} AS bin, {bin_case_sql(c, e, l, True)} AS bin_order, calculated_overdue FROM x"
    for d, (c, e, l) in _UNCUT.items()) + ") GROUP BY 1, 2, 3")
def an_upstream_activity_bins(spark, sf):
    """KPI and parent comment bins and subtask-history bins over uncut counts -> rate."""
    r = roles(spark, sf)
    b = lbl.with_three_tier(cut.base_tasks(r.task), r.task_history)
    cm = r.comment.groupBy("content_type_id", "object_id").agg(F.count("*").alias("_n"))
    of = lambda t, k, n: cm.where(F.col("content_type_id") == t).select(F.col("object_id").alias(k), F.col("_n").alias(n))
    per_sub = r.sub_task_history.where("id is not null").groupBy(F.col("id").alias("_sid")).agg(F.count("*").alias("_h"))
    sh = per_sub.join(r.sub_task.select(F.col("id").alias("_st"), F.col("task_id").alias("_tid")), F.col("_sid") == F.col("_st")).groupBy(
        "_tid").agg(F.sum("_h").alias("total_sub_history_entries"))
    x = (b.join(r.major_activity.select(F.col("id").alias("_maid"), "kpi_id"), F.col("major_activity_id") == F.col("_maid"), "left")
          .join(of(22, "_ko", "kpi_comment_count"), F.col("kpi_id") == F.col("_ko"), "left")
          .join(of(23, "_mo", "ma_comment_count"), F.col("major_activity_id") == F.col("_mo"), "left")
          .join(sh, F.col("id") == F.col("_tid"), "left")
          .fillna(0, ["kpi_comment_count", "ma_comment_count", "total_sub_history_entries"]))
    bins = F.array(*[F.struct(F.lit(d).alias("dimension"), right_closed_bin(c, e, l).alias("bin"), bin_index(c, e).alias("bin_order"))
                     for d, (c, e, l) in _UNCUT.items()])
    return an.rate_by(x.select(F.explode(bins).alias("_d"), "calculated_overdue").select("_d.*", "calculated_overdue"),
                      ["dimension", "bin", "bin_order"])


_SCORES = ("risk_mapping", "planned_duration", "creation_to_planned_start")


@register("an_score_matrix", round_cols=("null_pct", "r"), oracle=f"WITH {BASE_CTES} " + " UNION ALL ".join(
    f"SELECT '{a}' AS score, '{b}' AS other, (count(*) - count({a})) * 100.0 / count(*) AS null_pct, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM base"
    for a in _SCORES for b in (*_SCORES, "calculated_overdue")))
def an_score_matrix(spark, sf):
    """Score columns: null % and correlation with each other and the target."""
    r = roles(spark, sf)
    b = lbl.with_three_tier(cut.base_tasks(r.task), r.task_history)
    pairs = [(x, y) for x in _SCORES for y in (*_SCORES, "calculated_overdue")]
    null = {x: ((F.count("*") - F.count(x)) * 100.0 / F.count("*")) for x in _SCORES}
    one = b.agg(F.array(*[F.struct(F.lit(x).alias("score"), F.lit(y).alias("other"), null[x].alias("null_pct"),
                                   F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r")) for x, y in pairs]).alias("m"))
    return one.select(F.explode("m").alias("m")).select("m.*")


@register("sink_summary", round_cols=("overdue_rate",), oracle=f"""WITH {BASE_CTES}
SELECT target_source, count(*) AS num_tasks, avg(calculated_overdue) AS overdue_rate FROM base GROUP BY 1""")
def sink_summary(spark, sf):
    """Analysis summary written by its sink and read back."""
    r = roles(spark, sf)
    b = lbl.with_three_tier(cut.base_tasks(r.task), r.task_history)
    s = b.groupBy("target_source").agg(F.count("*").alias("num_tasks"), F.avg("calculated_overdue").alias("overdue_rate"))
    path = sk.scratch_dir(spark, "summary")
    sk.write_summary_csv(s, path)
    return rd.load_summary_csv(spark, path, s.schema)
