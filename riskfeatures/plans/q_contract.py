"""Registered queries: dataset contract, pre-aggregated joins, latest row per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CONTENT_TYPE
from ..functions.scalar import sql_round
from ..operators.windows import latest_per_key
from ..sources.roles import roles
from . import features as feat
from .catalog import register
from .oracle_wide import DUAL, STATIC, feat_with
from .q_analytics import _feat

# ---- fixed values: the creation dataset contract ------------------------------
CREATION_CONTRACT = tuple(c.strip() for c in STATIC.split(",")) + DUAL
DROPPED_FEATURES = ("num_challenges", "has_challenges", "has_subtask_challenge", "num_subtask_challenges",
                    "has_kpi_challenge", "num_kpi_challenges", "has_kpi_potential_challenge",
                    "num_kpi_potential_challenges", "position_id_encoded")
CONTRACT = {"creation": CREATION_CONTRACT, "halfway": CREATION_CONTRACT + ("days_since_update", "subtask_completion_pct_at_halfway")}


def _contract_sql(dataset: str) -> str:
    contract = CONTRACT[dataset]
    nn = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in contract)
    exp = ", ".join(f"('{c}')" for c in contract)
    drop = ", ".join(f"('{c}')" for c in DROPPED_FEATURES)
    return feat_with(f"""
, one AS (SELECT count(*) AS n, count(*) - count(DISTINCT id) AS dup_ids, CAST({nn} AS BIGINT) AS null_cells,
    count(*) FILTER (WHERE calculated_overdue NOT IN (0, 1)) AS non_binary, avg(calculated_overdue) AS rate,
    count(*) FILTER (WHERE status_encoded NOT IN (0, 1, 2, 3, 4)) AS bad_ordinal FROM feat),
actual AS (SELECT unnest(json_keys(to_json(f))) AS c FROM (SELECT * FROM feat LIMIT 1) f),
expected AS (SELECT * FROM (VALUES {exp}) v(c)),
dropped AS (SELECT * FROM (VALUES {drop}) v(c))
SELECT 'row_count' AS check_name, CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(n AS BIGINT) AS value FROM one
UNION ALL SELECT 'no_duplicate_ids', CASE WHEN dup_ids = 0 THEN 'PASS' ELSE 'FAIL' END, CAST(dup_ids AS BIGINT) FROM one
UNION ALL SELECT 'no_nulls', CASE WHEN null_cells = 0 THEN 'PASS' ELSE 'FAIL' END, null_cells FROM one
UNION ALL SELECT 'binary_target', CASE WHEN non_binary = 0 THEN 'PASS' ELSE 'FAIL' END, CAST(non_binary AS BIGINT) FROM one
UNION ALL SELECT 'target_rate_band', CASE WHEN rate BETWEEN 0.05 AND 0.95 THEN 'PASS' ELSE 'FAIL' END, CAST(round(rate * 10000) AS BIGINT) FROM one
UNION ALL SELECT 'ordinal_range', CASE WHEN bad_ordinal = 0 THEN 'PASS' ELSE 'FAIL' END, CAST(bad_ordinal AS BIGINT) FROM one
UNION ALL SELECT 'missing_columns', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM (SELECT c FROM expected EXCEPT SELECT c FROM actual)
UNION ALL SELECT 'unexpected_columns', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM (SELECT c FROM actual EXCEPT SELECT c FROM expected)
UNION ALL SELECT 'dropped_features_absent', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM (SELECT c FROM dropped INTERSECT SELECT c FROM actual)
UNION ALL SELECT 'challenge_columns_absent', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*) FROM actual WHERE c LIKE '%challenge%'""", dataset)


def _contract(f, contract):
    one = f.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("dup_ids"),
                sum(F.count_if(F.col(c).isNull()) for c in f.columns).cast("bigint").alias("null_cells"),
                F.count_if(~F.col("calculated_overdue").isin(0, 1)).alias("non_binary"),
                F.avg("calculated_overdue").alias("rate"),
                F.count_if(~F.col("status_encoded").isin(0, 1, 2, 3, 4)).alias("bad_ordinal"))
    have = set(f.columns)
    counts = {"missing_columns": len(set(contract) - have), "unexpected_columns": len(have - set(contract)),
              "dropped_features_absent": len(have & set(DROPPED_FEATURES)),
              "challenge_columns_absent": sum("challenge" in c for c in have)}

    def row(name, ok, v):
        return F.struct(F.lit(name).alias("check_name"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), v.cast("bigint").alias("value"))
    return one.select(F.explode(F.array(
        row("row_count", F.col("n") > 0, F.col("n")),
        row("no_duplicate_ids", F.col("dup_ids") == 0, F.col("dup_ids")),
        row("no_nulls", F.col("null_cells") == 0, F.col("null_cells")),
        row("binary_target", F.col("non_binary") == 0, F.col("non_binary")),
        row("target_rate_band", F.col("rate").between(0.05, 0.95), sql_round(F.col("rate") * 10000)),
        row("ordinal_range", F.col("bad_ordinal") == 0, F.col("bad_ordinal")),
        *[row(k, F.lit(v == 0), F.lit(v)) for k, v in counts.items()],
    )).alias("r")).select("r.*")


@register("dq_schema_contract", oracle=" UNION ALL ".join(
    f"SELECT '{d}' AS dataset, * FROM (\n{_contract_sql(d)}\n)" for d in CONTRACT))
def dq_schema_contract(spark, sf):
    """Dataset contract of both checkpoint datasets: row count, duplicate ids, no
    NULL in any column, binary target, target-rate band, ordinal range, and the
    column contract — exact set (U4 set differences), dropped features absent,
    no column matching 'challenge' (F11) (Q22)."""
    a, b = (_contract(_feat(spark, sf, d), c).select(F.lit(d).alias("dataset"), "*") for d, c in CONTRACT.items())
    return a.unionByName(b)


@register("join_preagg", oracle="""SELECT t.id, CAST(coalesce(s.n, 0) AS BIGINT) AS num_subtasks,
  CAST(coalesce(c.n, 0) AS BIGINT) AS task_comment_count, CAST(coalesce(ch.n, 0) AS BIGINT) AS num_challenges
FROM task t
LEFT JOIN (SELECT task_id, count(*) AS n FROM sub_task WHERE task_id IS NOT NULL GROUP BY 1) s ON s.task_id = t.id
LEFT JOIN (SELECT object_id, count(*) AS n FROM comment WHERE content_type_id = 24 GROUP BY 1) c ON c.object_id = t.id
LEFT JOIN (SELECT task_id, count(*) AS n FROM task_challenge WHERE task_id IS NOT NULL GROUP BY 1) ch ON ch.task_id = t.id""")
def join_preagg(spark, sf):
    """1:N children pre-aggregated on the join key (map-side partial counts),
    then left-joined and filled with 0 — never join-then-aggregate (J5)."""
    r = roles(spark, sf)

    def pre(df, key, name, cond=None):
        d = df.filter(F.col(key).isNotNull() & (cond if cond is not None else F.lit(True)))
        return d.groupBy(F.col(key).alias(f"_k_{name}")).agg(F.count(F.lit(1)).alias(name))
    out = r.task.select("id")
    for df, key, name, cond in ((r.sub_task, "task_id", "num_subtasks", None),
                                (r.comment, "object_id", "task_comment_count",
                                 F.col("content_type_id") == CONTENT_TYPE["task"]),
                                (r.task_challenge, "task_id", "num_challenges", None)):
        p = pre(df, key, name, cond)
        out = out.join(p, F.col("id") == F.col(f"_k_{name}"), "left").drop(f"_k_{name}")
    return out.fillna(0, ["num_subtasks", "task_comment_count", "num_challenges"])


@register("win_latest_per_key", oracle="""SELECT id, status, history_date, history_id FROM (
  SELECT id, status, history_date, history_id,
    row_number() OVER (PARTITION BY id ORDER BY history_date DESC, history_id DESC) AS rn FROM sub_task_history) WHERE rn = 1""")
def win_latest_per_key(spark, sf):
    """Latest row per key (DISTINCT ON ... ORDER BY ts DESC) as row_number() = 1:
    Spark plans a partial WindowGroupLimit before the shuffle, so at most one
    row per key and map partition is exchanged, even for a hot key (W5)."""
    h = roles(spark, sf).sub_task_history
    return latest_per_key(h, ["id"], [F.col("history_date").desc(), F.col("history_id").desc()]).select(
        "id", "status", "history_date", "history_id")
