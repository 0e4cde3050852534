"""Registered queries: sources, sinks and metadata audits (round trips)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import cutoffs as cut
from ..operators import metrics as M
from ..sources import readers as rd
from ..sources import sinks as sk
from ..sources.role_sql import ROLE_SQL
from ..sources.roles import BASE_TABLES, roles
from . import features as feat
from .catalog import register
from .oracle_wide import WIDE_CTES, checkpoint_cte
from .q_core import CKPT_DOUBLES
from .q_ml import _CUM_SQL, _thr_sql


@register("src_tables", oracle=" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in ROLE_SQL))
def src_tables(spark, sf):
    """Source inventory: every role table of the source schema and its row count."""
    r = roles(spark, sf)
    out = None
    for n in ROLE_SQL:
        c = getattr(r, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


@register("src_base_tasks", oracle="""SELECT id, status, approval_status, lead_approval_status, weight_level,
  CAST(is_planned AS INT) AS is_planned, risk_mapping, start_date, end_date, actual_end_date, created_date, updated_date,
  major_activity_id, position_id, department_id,
  CAST(CASE WHEN derived_from_cross_department_assignment_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS is_cross_dept
FROM task WHERE start_date IS NOT NULL AND end_date IS NOT NULL""")
def src_base_tasks(spark, sf):
    """Base extraction: explicit projection, bool -> int, FK-presence flag."""
    b = cut.base_tasks(roles(spark, sf).task)
    return b.select("id", "status", "approval_status", "lead_approval_status", "weight_level", "is_planned",
                    "risk_mapping", "start_date", "end_date", "actual_end_date", "created_date", "updated_date",
                    "major_activity_id", "position_id", "department_id", "is_cross_dept")


@register("src_checkpoint_csv", round_cols=CKPT_DOUBLES,
          oracle=f"WITH {WIDE_CTES},\n{checkpoint_cte('creation')}\nSELECT * FROM feat")
def src_checkpoint_csv(spark, sf):
    """Dataset sink + checkpoint reader round trip: the creation dataset is
    written as CSV with header and read back through the alias-aware reader
    ('t0' -> creation) with an explicit schema; a missing scenario yields an
    empty frame (S3, S4, S7)."""
    ds = feat.checkpoint_dataset(feat.feature_table(spark, sf), "creation")
    root = sk.scratch_dir(spark, "datasets")
    sk.write_checkpoint_csv(ds, rd.checkpoint_path(root, "creation"))
    schema = StructType(ds.schema.fields)
    back = rd.load_checkpoint_dataset(spark, "t0", root, schema)
    assert rd.load_scenario_dataset(spark, "halfway", root, schema).schema == schema
    return back


@register("sink_roundtrip", round_cols=CKPT_DOUBLES + ("subtask_completion_pct_at_halfway",),
          oracle=f"WITH {WIDE_CTES},\n{checkpoint_cte('halfway')}\nSELECT * FROM feat")
def sink_roundtrip(spark, sf):
    """Both checkpoint datasets written once as parquet partitioned by
    checkpoint; the reader prunes to checkpoint=halfway (S7, S8)."""
    w = feat.feature_table(spark, sf)
    path = sk.scratch_dir(spark, "features")
    sk.write_partitioned(feat.checkpoint_long(w), path)
    h = feat.checkpoint_dataset(w, "halfway")
    back = spark.read.parquet(path).filter(F.col("checkpoint") == "halfway")
    return back.select(*h.columns)


@register("src_metrics_json", oracle=_thr_sql(0.5))
def src_metrics_json(spark, sf):
    """Metrics JSON sink + multi-line reader round trip."""
    m = M.threshold_metrics(roles(spark, sf).scored, 0.5)
    path = sk.scratch_dir(spark, "metrics")
    sk.write_json(m, path)
    return rd.load_metrics_json(spark, path).select(*m.columns)


@register("src_artifact_csv", round_cols=("fpr", "tpr", "threshold"), oracle="WITH " + _CUM_SQL.format(src="scored") + """,
k AS (SELECT c.*, lag(fps) OVER w AS pfp, lead(fps) OVER w AS nfp, lag(tps) OVER w AS ptp, lead(tps) OVER w AS ntp,
  count(*) OVER () AS npts FROM c WINDOW w AS (ORDER BY idx))
SELECT 0.0 AS fpr, 0.0 AS tpr, CAST('inf' AS DOUBLE) AS threshold
UNION ALL SELECT fps * 1.0 / N, tps * 1.0 / P, score FROM k
WHERE idx = 1 OR idx = npts OR nfp - 2 * fps + pfp <> 0 OR ntp - 2 * tps + ptp <> 0""")
def src_artifact_csv(spark, sf):
    """Artifact CSV sink + schema-typed reader round trip (ROC curve artifact)."""
    roc = M.roc_curve(M.cumulative(roles(spark, sf).scored))
    path = sk.scratch_dir(spark, "artifacts") + "/roc_curve"
    sk.write_artifact_csv(roc, path)
    return rd.load_artifact_csv(spark, path, "roc_curve")


def _family_sql(col):
    return (f"CASE WHEN {col} LIKE '%[]' THEN 'array' WHEN {col} IN ('BIGINT','INTEGER','SMALLINT','TINYINT') THEN 'integer' "
            f"WHEN {col} IN ('DOUBLE','FLOAT') OR {col} LIKE 'DECIMAL%' THEN 'float' WHEN {col} LIKE 'TIMESTAMP%' THEN 'timestamp' "
            f"WHEN {col} = 'VARCHAR' THEN 'string' WHEN {col} = 'DATE' THEN 'date' WHEN {col} = 'BOOLEAN' THEN 'boolean' ELSE lower({col}) END")


_TABLE_LIST = ", ".join(f"'{t}'" for t in BASE_TABLES)


@register("src_schema_audit", oracle=f"""SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS ordinal_position,
  {_family_sql('data_type')} AS type_family FROM information_schema.columns WHERE table_name IN ({_TABLE_LIST})""")
def src_schema_audit(spark, sf):
    """Schema introspection of the source tables (column, ordinal, type family)."""
    from ..sources.roles import register_tables
    register_tables(spark, sf)
    return rd.schema_rows(spark, {t: spark.table(t) for t in BASE_TABLES})


@register("src_time_travel_audit", oracle=f"""SELECT table_name, count(*) AS n_columns,
  bool_or({_family_sql('data_type')} IN ('timestamp', 'date')) AS time_travel_capable,
  coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (WHERE {_family_sql('data_type')} IN ('timestamp', 'date')), '') AS time_columns
FROM information_schema.columns WHERE table_name IN ({_TABLE_LIST}) GROUP BY 1""")
def src_time_travel_audit(spark, sf):
    """Which source tables can be time-travelled: has a date / timestamp column."""
    s = src_schema_audit(spark, sf)
    is_t = F.col("type_family").isin("timestamp", "date")
    return s.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"), F.max(is_t).alias("time_travel_capable"),
        F.array_join(F.array_sort(F.collect_list(F.when(is_t, F.col("column_name")))), ", ").alias("time_columns"))


@register("src_normalise_ts", oracle="""SELECT o_orderkey AS id, 'orderdate' AS src, raw, TRY_CAST(raw AS TIMESTAMP) AS parsed FROM (
  SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS raw FROM orders)
UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, TRY_CAST(o_orderpriority AS TIMESTAMP) FROM orders""")
def src_normalise_ts(spark, sf):
    """Timestamp normalisation: text -> timestamp_ntz, bad values -> NULL, over
    every order's date text and (unparseable) priority text (S12)."""
    from ..sources.roles import register_tables
    register_tables(spark, sf)
    o = spark.table("orders")
    txt = (o.select(F.col("o_orderkey").alias("id"), F.lit("orderdate").alias("src"),
                    F.col("o_orderdate").cast("string").alias("raw"))
           .unionByName(o.select(F.col("o_orderkey").alias("id"), F.lit("priority").alias("src"),
                                 F.col("o_orderpriority").alias("raw"))))
    return rd.normalise_timestamps(txt, "raw", "parsed")
