"""Plan-shape assertions: the scale properties we rely on."""

from pyspark.sql import functions as F

from tests.scales import SF_SMALL
from riskfeatures.operators.windows import expanding_mean
from riskfeatures.plans import features as feat
from riskfeatures.sources.roles import roles


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_table_has_no_cartesian_product(spark):
    p = _plan(feat.leak_free_wide(roles(spark, SF_SMALL)))
    assert "CartesianProduct" not in p
    # the only nested-loop join is the 1-row global-mean broadcast
    assert p.count("BroadcastNestedLoopJoin") <= 1


def test_filters_and_columns_reach_the_scan(spark):
    """Roles are views: a filter on a bound column reaches the given file's scan, one
    on a derived column stands right above it, and only needed columns are read."""
    th = roles(spark, SF_SMALL).task_history
    df = th.filter((F.col("history_relation_id") == 7) & (F.col("status") == "completed")).select("history_relation_id")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,7)]" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_linestatus:string>" in p
    assert "Exchange" not in p


def test_expanding_windows_are_partitioned(spark):
    r = roles(spark, SF_SMALL)
    df = expanding_mean(r.task.withColumn("y", F.lit(1)), "department_id", "created_date", "id", ["y"])
    p = _plan(df)
    # every window is partitioned (no single-partition global window)
    for line in p.split("\n"):
        if line.strip().startswith(("Window [", "+- Window [", ":- Window [")) or " Window [" in line:
            assert "department_id" in line
