"""Registered queries: statistics and feature-selection tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as st
from ..operators.aggs import _stack
from ..sources.roles import roles
from .catalog import register
from .curated import FEATURE_VERDICTS, LEAK_REGISTER
from .oracle_curated import CURATED_VERDICTS_SQL, LEAK_REGISTER_SQL
from .oracle_wide import NUMERIC_FEATS, TWO_TIER, feat_with
from .q_analytics import _feat
from .q_pit import _LEAK_SQL, _leak_long

# ---- fixed values: feature groups (signal-by-group report) ------------------
FEATURE_GROUPS = {
    "temporal": ("planned_duration", "creation_to_planned_start", "created_dow", "created_is_weekend", "created_is_friday",
                 "created_month", "created_quarter", "days_since_update"),
    "status": ("status_encoded", "approval_status_encoded", "lead_approval_status_encoded", "ma_status_encoded",
               "ma_approval_status_encoded"),
    "history": ("num_revisions", "revision_frequency", "revision_recency", "avg_sub_status_changes"),
    "subtask": ("num_subtasks", "has_subtasks", "subtask_completion_pct", "subtask_overdue_rate",
                "subtask_completion_pct_at_halfway"),
    "organisation": ("dept_past_overdue_rate", "dept_avg_revisions", "emp_past_overdue_rate", "pos_past_overdue_rate",
                     "is_cross_dept", "cross_dept_pair_exists", "risk_mapping", "is_planned"),
    "upstream": ("num_ma_revisions", "kpi_is_overdue_flag", "kpi_status_ordinal", "num_kpi_revisions",
                 "task_comment_count"),
}
ALL_FEATS = tuple(c for g in FEATURE_GROUPS.values() for c in g)
BINARY_FEATS = ("has_subtasks", "is_cross_dept", "cross_dept_pair_exists", "is_planned",
                "kpi_is_overdue_flag", "created_is_weekend", "created_is_friday")
CATEGORY_FEATS = ("created_dow", "created_month", "created_quarter", "risk_mapping", "status_encoded", "approval_status_encoded",
                  "lead_approval_status_encoded", "ma_status_encoded", "ma_approval_status_encoded", "kpi_status_ordinal")


def _corr_sql(cols, src="feat"):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(calculated_overdue AS DOUBLE)) AS pearson_r FROM {src}"
        for c in cols)


def _student_sql(t, dof):
    """Two-sided p of Student's t as the finite sums for even and odd degrees of freedom."""
    cos = f"ln(1 / sqrt(1 + {t} * {t} / {dof}))"
    sin = f"(abs({t}) / sqrt({dof} + {t} * {t}))"
    even = f"{sin} * list_sum(list_transform(range(0, {dof} // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) - 0.5 * ln(pi()) + 2 * k * {cos})))"
    odd = (f"2 / pi() * (atan(abs({t}) / sqrt({dof})) + {sin} * list_sum(list_transform(range(0, ({dof} - 1) // 2), "
           f"lambda k: exp(0.5 * ln(pi()) - ln(2) + lgamma(k + 1.0) - lgamma(k + 1.5) + (2 * k + 1) * {cos}))))")
    return f"greatest(0, 1 - CASE WHEN {dof} % 2 = 0 THEN {even} ELSE {odd} END)"


def _chi2_p_sql(x, dof):
    """Upper tail of chi-square from the series of the lower one."""
    return (f"CASE WHEN {dof} = 0 OR {x} = 0 THEN 1.0 ELSE greatest(0, 1 - list_sum(list_transform(range(0, CAST({x} / 2 + 12 * sqrt({x} / 2 + 1) + 200 AS BIGINT)), "
            f"lambda k: exp(-{x} / 2 + ({dof} / 2.0 + k) * ln({x} / 2) - lgamma({dof} / 2.0 + k + 1))))) END")


@register("st_corr_target", round_cols=("pearson_r", "abs_r", "t_stat", "p_value"), oracle=feat_with(f"""
, r AS ({_corr_sql(ALL_FEATS)}), n AS (SELECT count(*) AS n FROM feat),
t AS (SELECT feature, pearson_r, abs(pearson_r) AS abs_r, n, pearson_r * sqrt((n - 2) / (1 - pearson_r * pearson_r)) AS t_stat FROM r CROSS JOIN n)
SELECT *, {_student_sql("t_stat", "(n - 2)")} AS p_value FROM t""", "halfway"))
def st_corr_target(spark, sf):
    """Pearson r of every feature with the target from one Gram matrix, |r|, t statistic, p."""
    return st.corr_with_target(_feat(spark, sf, "halfway"), ALL_FEATS, "calculated_overdue")


_GROUP_VALUES = ", ".join(f"('{c}', '{g}')" for g, cs in FEATURE_GROUPS.items() for c in cs)


@register("st_corr_groups", round_cols=("best_abs_r", "mean_abs_r", "best_p"), oracle=feat_with(f"""
, r AS ({_corr_sql(ALL_FEATS)}), n AS (SELECT count(*) AS n FROM feat), fgrp AS (SELECT * FROM (VALUES {_GROUP_VALUES}) v(feature, feature_group)),
g AS (SELECT feature_group, max(abs(pearson_r)) AS best_abs_r, avg(abs(pearson_r)) AS mean_abs_r,
  arg_max(feature, (abs(pearson_r), feature)) AS best_feature, count(*) AS n_features FROM r JOIN fgrp USING (feature) GROUP BY 1),
t AS (SELECT g.*, n, best_abs_r * sqrt((n - 2) / (1 - best_abs_r * best_abs_r)) AS t FROM g CROSS JOIN n)
SELECT * EXCLUDE (n, t), {_student_sql("t", "(n - 2)")} AS best_p FROM t""", "halfway"))
def st_corr_groups(spark, sf):
    """Per feature group: best and mean |r|, the best feature and its p."""
    c = st.corr_with_target(_feat(spark, sf, "halfway"), ALL_FEATS, "calculated_overdue")
    gm = spark.createDataFrame([(c_, g) for g, cs in FEATURE_GROUPS.items() for c_ in cs],
                               ["feature", "feature_group"])
    return (c.join(F.broadcast(gm), "feature").groupBy("feature_group").agg(
        F.max("abs_r").alias("best_abs_r"), F.avg("abs_r").alias("mean_abs_r"),
        F.max_by("feature", F.struct("abs_r", "feature")).alias("best_feature"),
        F.count(F.lit(1)).alias("n_features"), F.max_by("p_value", F.struct("abs_r", "feature")).alias("best_p")))


_PAIR_COLS = NUMERIC_FEATS


@register("st_high_corr_pairs", round_cols=("r",), oracle=feat_with("""
, r AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM feat"
    for i, a in enumerate(_PAIR_COLS) for b in _PAIR_COLS[i + 1:]) + """)
SELECT feature_a, feature_b, r FROM r WHERE abs(r) > 0.75 ORDER BY abs(r) DESC""", "halfway"))
def st_high_corr_pairs(spark, sf):
    """Correlation matrix pairs with |r| > 0.75, sorted by |r|."""
    p = st.pairwise_corr(_feat(spark, sf, "halfway"), _PAIR_COLS)
    return p.filter(F.abs("r") > 0.75).orderBy(F.abs("r").desc())


_YATES = "o + sign(e - o) * least(0.5, abs(e - o))"


@register("st_binary_signal", round_cols=("pb_r", "pb_p", "chi2_p", "rate_when_1", "rate_when_0", "lift"), oracle=feat_with("""
, b AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, corr(CAST({c} AS DOUBLE), CAST(calculated_overdue AS DOUBLE)) AS pb_r, count(*) AS n,
  count(*) FILTER (WHERE {c} = 1 AND calculated_overdue = 1) AS n11, count(*) FILTER (WHERE {c} = 1) AS f1, sum(calculated_overdue) AS y1,
  avg(calculated_overdue) FILTER (WHERE {c} = 1) AS rate_when_1, avg(calculated_overdue) FILTER (WHERE {c} = 0) AS rate_when_0 FROM feat
  HAVING bool_and({c} IS NOT NULL AND {c} IN (0, 1)) AND min({c}) <> max({c})"""
    for c in NUMERIC_FEATS) + f"""),
cells AS (SELECT feature, n11 AS o, f1 * y1 / n AS e FROM b UNION ALL SELECT feature, f1 - n11, f1 * (n - y1) / n FROM b
  UNION ALL SELECT feature, y1 - n11, (n - f1) * y1 / n FROM b UNION ALL SELECT feature, n - f1 - y1 + n11, (n - f1) * (n - y1) / n FROM b),
chi AS (SELECT feature, sum(({_YATES} - e) * ({_YATES} - e) / e) AS x FROM cells GROUP BY 1),
p AS (SELECT feature, pb_r, {_student_sql("(pb_r * sqrt((n - 2) / (1 - pb_r * pb_r)))", "(n - 2)")} AS pb_p, {_chi2_p_sql("x", "1")} AS chi2_p,
  rate_when_1, rate_when_0, rate_when_1 / greatest(rate_when_0, 0.001) AS lift FROM b JOIN chi USING (feature))
SELECT *, CASE WHEN abs(pb_r) > 0.05 AND chi2_p < 0.05 THEN 'STRONG' ELSE 'WEAK' END AS signal FROM p""", "halfway"))
def st_binary_signal(spark, sf):
    """Point-biserial r and p, chi-square p, rate when 1 / 0, lift and STRONG/WEAK (|r| > .05
    and p < .05) of every feature that is binary in the data (X4)."""
    return st.binary_signals(_feat(spark, sf, "halfway"), NUMERIC_FEATS, "calculated_overdue")


def _chi_sql(c):
    return f"""SELECT '{c}' AS feature, sum((adj - e) * (adj - e) / e) AS chi2, max(dof) AS dof FROM (
  SELECT *, CASE WHEN dof = 1 THEN {_YATES} ELSE o END AS adj FROM (
    SELECT rf * cy / n AS e, CAST((kf - 1) * (ky - 1) AS BIGINT) AS dof, coalesce(ct.o, 0) AS o
    FROM (SELECT {c} AS f, count(*) AS rf FROM feat GROUP BY 1) r
    CROSS JOIN (SELECT calculated_overdue AS y, count(*) AS cy FROM feat GROUP BY 1) c
    CROSS JOIN (SELECT count(*) AS n, count(DISTINCT {c}) AS kf, count(DISTINCT calculated_overdue) AS ky FROM feat) t
    LEFT JOIN (SELECT {c} AS f, calculated_overdue AS y, count(*) AS o FROM feat GROUP BY 1, 2) ct ON ct.f = r.f AND ct.y = c.y) g)"""


@register("st_chi2", round_cols=("chi2", "p_value"), oracle=feat_with(
    "\n, x AS (" + " UNION ALL ".join(_chi_sql(c) for c in BINARY_FEATS + CATEGORY_FEATS) + f") SELECT *, {_chi2_p_sql('chi2', 'dof')} AS p_value FROM x", "halfway"))
def st_chi2(spark, sf):
    """Chi-square test of every binary and categorical feature x target; Yates for 2x2 as scipy."""
    return st.chi2_tests(_feat(spark, sf, "halfway"), BINARY_FEATS + CATEGORY_FEATS, "calculated_overdue")


_SIG_SQL = f"""WITH b AS (SELECT t.id, CAST({TWO_TIER} AS DOUBLE) AS y,
    CAST(m.is_overdue AS DOUBLE) AS milestone_is_overdue, CAST(ks.is_overdue AS DOUBLE) AS ksi_is_overdue,
    ks.status AS ksi_status, g.goal_name
  FROM task t LEFT JOIN major_activity ma ON ma.id = t.major_activity_id LEFT JOIN kpi k ON k.id = ma.kpi_id
  LEFT JOIN milestone m ON m.id = k.milestone_id LEFT JOIN ksi ks ON ks.id = m.ksi_id LEFT JOIN goal g ON g.id = k.goal_id
  WHERE t.start_date IS NOT NULL AND t.end_date IS NOT NULL),
s AS (
  SELECT 'milestone_is_overdue' AS feature, 'numeric' AS type, avg(CASE WHEN milestone_is_overdue IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate, abs(corr(milestone_is_overdue, y)) AS strength FROM b
  UNION ALL SELECT 'ksi_is_overdue', 'numeric', avg(CASE WHEN ksi_is_overdue IS NULL THEN 1.0 ELSE 0.0 END), abs(corr(ksi_is_overdue, y)) FROM b
  UNION ALL SELECT 'ksi_status', 'categorical', (SELECT avg(CASE WHEN ksi_status IS NULL THEN 1.0 ELSE 0.0 END) FROM b), max(r) - min(r) FROM (SELECT ksi_status, avg(y) AS r FROM b WHERE ksi_status IS NOT NULL GROUP BY 1)
  UNION ALL SELECT 'goal_name', 'categorical', (SELECT avg(CASE WHEN goal_name IS NULL THEN 1.0 ELSE 0.0 END) FROM b), max(r) - min(r) FROM (SELECT goal_name, avg(y) AS r FROM b WHERE goal_name IS NOT NULL GROUP BY 1))
SELECT feature, type, null_rate, strength, CASE WHEN strength > 0.10 THEN 'HIGH' WHEN strength > 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS signal FROM s"""


@register("st_signal_class", round_cols=("null_rate", "strength"), oracle=_SIG_SQL)
def st_signal_class(spark, sf):
    """Signal class of upstream features: |r| for numeric, max-min group rate for
    categorical; HIGH > .10, MEDIUM > .05 (X6, D17 features)."""
    from ..operators import cutoffs as cut
    from ..operators import labels as lbl
    r = roles(spark, sf)
    t = cut.dated(r.task)
    ma = r.major_activity.select(F.col("id").alias("_maid"), "kpi_id")
    k = r.kpi.select(F.col("id").alias("_kid"), "milestone_id", "goal_id")
    m = r.milestone.select(F.col("id").alias("_mid"), "ksi_id", F.col("is_overdue").cast("double").alias("milestone_is_overdue"))
    ks = r.ksi.select(F.col("id").alias("_ksid"), F.col("is_overdue").cast("double").alias("ksi_is_overdue"),
                      F.col("status").alias("ksi_status"))
    g = r.goal.select(F.col("id").alias("_gid"), "goal_name")
    b = (t.join(ma, F.col("major_activity_id") == F.col("_maid"), "left").join(k, F.col("kpi_id") == F.col("_kid"), "left")
         .join(m, F.col("milestone_id") == F.col("_mid"), "left").join(ks, F.col("ksi_id") == F.col("_ksid"), "left")
         .join(g, F.col("goal_id") == F.col("_gid"), "left")
         .select(lbl.two_tier().cast("double").alias("y"), "milestone_is_overdue", "ksi_is_overdue", "ksi_status", "goal_name"))
    num = b.agg(
        F.avg(F.col("milestone_is_overdue").isNull().cast("double")).alias("milestone_is_overdue|null_rate"),
        F.abs(F.corr("milestone_is_overdue", "y")).alias("milestone_is_overdue|strength"),
        F.avg(F.col("ksi_is_overdue").isNull().cast("double")).alias("ksi_is_overdue|null_rate"),
        F.abs(F.corr("ksi_is_overdue", "y")).alias("ksi_is_overdue|strength"))
    out = _stack(num, ["milestone_is_overdue", "ksi_is_overdue"], ["null_rate", "strength"]).withColumn("type", F.lit("numeric"))
    for c in ("ksi_status", "goal_name"):
        nr = b.agg(F.avg(F.col(c).isNull().cast("double")).alias("null_rate"))
        rr = b.filter(F.col(c).isNotNull()).groupBy(c).agg(F.avg("y").alias("r")).agg(
            (F.max("r") - F.min("r")).alias("strength"))
        out = out.unionByName(nr.crossJoin(rr).select(F.lit(c).alias("feature"), "null_rate", "strength",
                                                      F.lit("categorical").alias("type")))
    return out.withColumn("signal", F.when(F.col("strength") > 0.10, "HIGH").when(F.col("strength") > 0.05, "MEDIUM")
                          .otherwise("LOW"))


@register("st_feature_verdict", round_cols=("abs_r", "variance", "pct_zero"), oracle=feat_with(f"""
, p AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, abs(corr(CAST({c} AS DOUBLE), CAST(calculated_overdue AS DOUBLE))) AS abs_r,
  var_samp({c}) AS variance, avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END) * 100 AS pct_zero FROM feat""" for c in NUMERIC_FEATS) + f"""),
vm AS ({CURATED_VERDICTS_SQL})
SELECT coalesce(p.feature, vm.feature) AS feature, p.abs_r, p.variance, p.pct_zero, coalesce(vm.verdict, 'USE') AS verdict,
  coalesce(vm.reason, 'Default — standard feature') AS reason, p.feature IS NOT NULL AS in_dataset
FROM p FULL JOIN vm ON vm.feature = p.feature""", "halfway"))
def st_feature_verdict(spark, sf):
    """Feature verdicts with reasons: the curated map, USE where it has no entry, beside
    |r|, variance and sparsity of the features that the dataset holds (X7)."""
    f = _feat(spark, sf, "halfway")
    aggs = []
    for c in NUMERIC_FEATS:
        aggs += [F.abs(F.corr(F.col(c).cast("double"), F.col("calculated_overdue").cast("double"))).alias(f"{c}|abs_r"),
                 F.var_samp(F.col(c).cast("double")).alias(f"{c}|variance"),
                 (F.avg((F.col(c) == 0).cast("double")) * 100).alias(f"{c}|pct_zero")]
    p = _stack(f.agg(*aggs), NUMERIC_FEATS, ["abs_r", "variance", "pct_zero"]).withColumn("in_dataset", F.lit(True))
    vm = spark.createDataFrame([(k, *v) for k, v in FEATURE_VERDICTS.items()], "feature string, verdict string, reason string")
    return p.join(vm, "feature", "full").select("feature", "abs_r", "variance", "pct_zero", F.coalesce("verdict", F.lit("USE")).alias("verdict"),
                                                F.coalesce("reason", F.lit("Default — standard feature")).alias("reason"),
                                                F.coalesce("in_dataset", F.lit(False)).alias("in_dataset"))


@register("st_leak_register", oracle=_LEAK_SQL + f""", reg AS ({LEAK_REGISTER_SQL})
SELECT reg.risk, reg.feature, reg.mitigation, m.leaked_tasks, CAST(count(*) OVER (PARTITION BY reg.risk) AS BIGINT) AS n_of_risk
FROM reg LEFT JOIN (SELECT feature, count(*) FILTER (WHERE leak > 0) AS leaked_tasks FROM lk GROUP BY 1) m USING (feature)""")
def st_leak_register(spark, sf):
    """Leakage register (feature, risk, mitigation) with the measured leak where there is
    one, and the number of features of each risk (X8)."""
    lk = _leak_long(spark, sf).groupBy("feature").agg(F.count_if(F.col("leak") > 0).alias("leaked_tasks"))
    reg = spark.createDataFrame([(k, *v) for k, v in LEAK_REGISTER.items()], "feature string, risk string, mitigation string")
    sizes = reg.groupBy("risk").agg(F.count("*").alias("n_of_risk"))
    return reg.join(lk, "feature", "left").join(sizes, "risk").select("risk", "feature", "mitigation", "leaked_tasks", "n_of_risk")


@register("st_feature_summary", round_cols=("null_pct", "pearson_r"), oracle=feat_with(f"""
, fgrp AS (SELECT * FROM (VALUES {_GROUP_VALUES}) v(feature, feature_group)),
p AS (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, (count(*) - count({c})) * 100.0 / count(*) AS null_pct,
  corr(CAST({c} AS DOUBLE), CAST(calculated_overdue AS DOUBLE)) AS pearson_r FROM feat""" for c in ALL_FEATS) + """)
SELECT fgrp.feature_group, p.feature, p.null_pct, p.pearson_r,
  CASE WHEN abs(p.pearson_r) > 0.05 THEN 'KEEP' WHEN p.pearson_r IS NULL THEN 'DROP' ELSE 'REVIEW' END AS decision
FROM p JOIN fgrp USING (feature)""", "halfway"))
def st_feature_summary(spark, sf):
    """Feature summary by group: null %, r and a decision."""
    f = _feat(spark, sf, "halfway")
    aggs = []
    for c in ALL_FEATS:
        aggs += [((F.count(F.lit(1)) - F.count(c)) * 100.0 / F.count(F.lit(1))).alias(f"{c}|null_pct"),
                 F.corr(F.col(c).cast("double"), F.col("calculated_overdue").cast("double")).alias(f"{c}|pearson_r")]
    p = _stack(f.agg(*aggs), ALL_FEATS, ["null_pct", "pearson_r"])
    gm = spark.createDataFrame([(c_, g) for g, cs in FEATURE_GROUPS.items() for c_ in cs], ["feature", "feature_group"])
    return (p.join(F.broadcast(gm), "feature")
            .select("feature_group", "feature", "null_pct", "pearson_r",
                    F.when(F.abs("pearson_r") > 0.05, "KEEP").when(F.col("pearson_r").isNull(), "DROP")
                    .otherwise("REVIEW").alias("decision")))
