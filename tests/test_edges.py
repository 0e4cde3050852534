"""Edges: open bins, NULL statuses and keys, repeated bridge rows, quantiles, zero fill, order, shared folder."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.scales import SF_MID, SF_SMALL
from riskfeatures import session
from riskfeatures.functions.quantiles import exact_quantiles
from riskfeatures.functions.scalar import INF, bin_index
from riskfeatures.operators import ml, pit
from riskfeatures.plans import features as feat
from riskfeatures.plans import load_all
from riskfeatures.plans.catalog import QUERIES
from riskfeatures.plans.q_analytics import _ACT_SPECS, _BIN_SPECS

load_all()


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_binned_counts_sum_to_input(spark, sf):
    n = feat.feature_table(spark, sf).count()
    for name, specs in (("bin_fixed", _BIN_SPECS), ("an_activity_bins", _ACT_SPECS)):
        got = {r.dimension: r.n for r in QUERIES[name](spark, sf).groupBy("dimension").agg(F.sum("num_tasks").alias("n")).collect()}
        assert got == {d: n for d in specs}
    days = QUERIES["an_days_remaining"](spark, sf).collect()
    assert len(days) >= 6


def test_open_bins(spark):
    x = spark.createDataFrame([(v,) for v in (-1e9, -1.0, 0.0, 5.0, 1e300, None)], "v double")
    assert [r.b for r in x.select(bin_index("v", (-INF, -1, 0, INF)).alias("b")).collect()] == [0, 0, 1, 2, 2, None]


def test_quantiles_match_numpy(spark):
    rng = random.Random(1)
    vals = [rng.choice([0.0, 0.0, 0.0, rng.gauss(0, 1), rng.random() * 1e-12, -1e200, 1e308]) for _ in range(900)]
    rows = [(v if i % 7 else None, float(i % 3), None) for i, v in enumerate(vals)]
    probs = [0.0, 0.02, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = exact_quantiles(spark.createDataFrame(rows, "a double, b double, c double").repartition(5), ["a", "b", "c"], probs)
    for c, i in (("a", 0), ("b", 1)):
        want = np.quantile([r[i] for r in rows if r[i] is not None], probs)
        assert np.allclose(got[c], want, rtol=1e-12, atol=0)
    assert got["c"] == [None] * len(probs)


def test_null_status_is_no_value(spark):
    t = dt.datetime(2020, 1, 1)
    h = spark.createDataFrame([(1, t, "a", 1), (1, t, None, 2), (2, t, None, 3)], "id int, ts timestamp_ntz, status string, seq int")
    got = pit.churn_first_seen(h, "id", "ts", "status", ["seq"]).groupBy("id").agg(F.count("ts").alias("n"))
    assert {(r.id, r.n) for r in got.collect()} == {(1, 1), (2, 0)}


def test_cutoffs_without_key(spark):
    t = dt.datetime(2020, 1, 1)
    e = spark.createDataFrame([(1, t, 1, "x")], "k int, ts timestamp_ntz, seq int, v string")
    c = spark.createDataFrame([(i, None if i < 50 else 1, t) for i in range(60)], "cid int, k int, cts timestamp_ntz")
    got = pit.pit_merge(e, c, "k", "k", "ts", "cts", seq=["seq"], values=["v"], carry=["cid"]).collect()
    assert sorted((r.cid, r.pit_n) for r in got) == [(i, 0 if i < 50 else 1) for i in range(60)]


def test_zero_filled(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, "3.5", 2, 1.5, "s"), (3, "bad", 0, 0.0, "s")],
                               "id int, t string, i int, d double, target_source string")
    got = [tuple(r) for r in feat.zero_filled(df).orderBy("id").collect()]
    assert got == [(1, 0.0, 0, 0.0, None), (2, 3.5, 2, 1.5, "s"), (3, 0.0, 0, 0.0, "s")]


def test_wide_table_is_ordered(spark):
    ids = [r.id for r in QUERIES["feat_leak_free_wide"](spark, SF_SMALL).select("id").collect()]
    assert ids == sorted(ids)


def test_wide_analytics_read_their_columns_only(spark):
    plan = QUERIES["an_peak_month"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" not in plan and "num_kpi_revisions" not in plan


def test_training_uses_the_checkpoints_preprocessor(spark):
    half = feat.checkpoint_dataset(feat.feature_table(spark, SF_SMALL), "halfway")
    out = ml.PREPROCESS["halfway"](half)
    assert "duration_revision_intensity" in out.columns and "subtask_completion_pct" not in out.columns
    assert out.agg(F.max("num_revisions"), F.max("num_ma_revisions"), F.min("planned_duration")).first()[2] >= 0


def test_label_reads_its_tables_only(spark):
    plan = QUERIES["lbl_v1"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "orders" in plan and "lineitem" not in plan and "documents" not in plan


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Cluster())


def test_artifacts_of_every_kind(spark, tmp_path):
    from riskfeatures.sources import readers as rd
    from riskfeatures.sources import sinks as sk
    rows = {"roc_curve": [(0.0, 0.5, float("inf"))], "confusion_matrix": [("0", 3, 1)], "feature_importance": [("a", 0.25)],
            "predictions": [(1, 0, 0.125)], "shap_matrix": [(1, "a", -0.5)]}
    assert rows.keys() == rd.ARTIFACT_SCHEMAS.keys()
    for kind, want in rows.items():
        assert rd.load_artifact_csv(spark, str(tmp_path / kind), kind).count() == 0
        sk.write_artifact_csv(spark.createDataFrame(want, rd.ARTIFACT_SCHEMAS[kind]), str(tmp_path / kind))
        assert [tuple(r) for r in rd.load_artifact_csv(spark, str(tmp_path / kind), kind).collect()] == want
    sk.write_artifact_csv(spark.createDataFrame([(1, 0.5, -1.0), (2, 0.0, None)], "id long, `f.a` double, b double"), str(tmp_path / "wide"))
    got = sorted(rd.load_matrix_csv(spark, str(tmp_path / "wide")).where("value is not null").collect())
    assert [tuple(r) for r in got] == [(1, "b", -1.0), (1, "f.a", 0.5), (2, "f.a", 0.0)]
    assert rd.load_matrix_csv(spark, str(tmp_path / "none")).count() == 0 and rd.load_model(spark, str(tmp_path / "none")) is None


def test_answers_follow_the_folder(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    before = session.state_of(spark, str(tmp_path))
    assert before == session.state_of(spark, str(tmp_path))
    spark.range(2).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert before != session.state_of(spark, str(tmp_path))
