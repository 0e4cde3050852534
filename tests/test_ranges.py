"""Running values over range partitions: a hot group, one day and bunched scores spread over all tasks."""

import datetime as dt
import random

from pyspark.sql import functions as F

from riskfeatures.operators import metrics as M
from riskfeatures.operators import pit
from riskfeatures.operators.ranges import partitions, scan
from riskfeatures.operators.windows import expanding_mean, global_row_number


def largest_share(df):
    n = [r["count"] for r in df.groupBy("part").count().collect()]
    return max(n) / sum(n)


def test_hot_group_on_one_day(spark):
    t0 = dt.datetime(2020, 5, 5)
    rows = [(i, None if i % 50 == 0 else 7, t0 + dt.timedelta(seconds=i % 40), i % 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, g int, ts timestamp_ntz, v int").repartition(3)
    got = scan(df, ["g"], ["ts", "id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.when(F.col("v") > 0, F.col("id")))}, inclusive=False)
    assert largest_share(got) <= 2.0 / partitions(df)
    state = {}
    want = {}
    for i, g, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        s, m, last = state.get(g, (0, None, None))
        want[i] = (s, m, last)
        state[g] = (s + v, v if m is None else max(m, v), i if v > 0 else last)
    assert {r.id: (r.s, r.m, r.l) for r in got.collect()} == want
    means = {r.id: r.v_expanding_mean for r in expanding_mean(df, "g", "ts", "id", ["v"]).collect()}
    assert means[rows[0][0]] is None and abs(sum(x for x in means.values() if x is not None) / 3998 - 1) < 0.1


def test_as_of_scan_of_one_key_on_one_day(spark):
    rng = random.Random(3)
    t0 = dt.datetime(2020, 5, 5)
    ev = [(1, t0 + dt.timedelta(seconds=rng.randrange(1000)), i, f"v{i}") for i in range(1500)]
    cu = [(i, 1, t0 + dt.timedelta(seconds=rng.randrange(1000))) for i in range(1500)]
    got = pit.pit_merge(spark.createDataFrame(ev, "k int, ts timestamp_ntz, seq int, v string"),
                        spark.createDataFrame(cu, "cid int, k int, cts timestamp_ntz"), "k", "k", "ts", "cts", seq=["seq"], values=["v"], carry=["cid"])
    ev.sort(key=lambda e: (e[1], e[2]))
    for r in got.collect():
        before = [e for e in ev if e[1] <= cu[r.cid][2]]
        assert r.pit_n == len(before) and r.pit_last_ts == (before[-1][1] if before else None)
        assert (r.pit_last["v"] if r.pit_last else None) == (before[-1][3] if before else None)


def test_bunched_scores(spark):
    rng = random.Random(4)
    rows = [(i % 2, rng.random() * (0.01 if i % 50 else 1.0)) for i in range(3000)]
    df = spark.createDataFrame(rows, "label int, score double")
    cum = M.cumulative(df)
    assert largest_share(cum) <= 2.0 / partitions(df)
    pts = M.roc_curve(cum).collect()
    full = M.roc_curve(cum, drop_intermediate=False).collect()
    want, tp, fp = [], 0, 0
    for y, s in sorted(rows, key=lambda r: -r[1]):
        tp, fp = tp + y, fp + 1 - y
        want.append((fp, tp, s))
    assert sorted((round(r.fpr * 1500), round(r.tpr * 1500), r.threshold) for r in full if r.threshold != float("inf")) == sorted(want)
    bends = [w for i, w in enumerate(want) if i in (0, len(want) - 1) or want[i + 1][0] - 2 * w[0] + want[i - 1][0] or want[i + 1][1] - 2 * w[1] + want[i - 1][1]]
    assert sorted((round(r.fpr * 1500), round(r.tpr * 1500), r.threshold) for r in pts if r.threshold != float("inf")) == sorted(bends)


def test_metrics_of_many_groups_in_one_pass(spark):
    rng = random.Random(5)
    rows = [(g, rng.randrange(2), round(rng.random(), 2)) for g in (0, 1, 2) for _ in range(300)]
    df = spark.createDataFrame(rows, "g int, label int, score double")
    cum = M.cumulative(df, by=["g"])
    ap = dict(M.average_precision(cum, by=["g"]).collect())
    auc = dict(M.roc_auc(cum, by=["g"]).collect())
    for g in (0, 1, 2):
        one = M.cumulative(df.where(F.col("g") == g))
        assert abs(M.average_precision(one).first()[0] - ap[g]) < 1e-12 and abs(M.roc_auc(one).first()[0] - auc[g]) < 1e-12


def test_global_numbers_are_spread(spark):
    df = spark.range(5000).select(F.lit(1).alias("q"), (F.col("id") * 7919 % 5000).alias("id"))
    got = global_row_number(df, ["q", "id"], "n")
    assert got.where("n <> id + 1").count() == 0 and got.count() == 5000


def test_split_cuts_equal_ranks(spark):
    df = spark.range(997).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"))
    got = {r.id: r.split for r in M.stratified_split(df, "id", "label").collect()}
    import hashlib
    for label in (0, 1):
        ids = sorted((i for i in range(997) if int(i % 3 == 0) == label), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
        n = len(ids)
        a, b = (n * 70 + 50) // 100, (n * 15 + 50) // 100
        assert [got[i] for i in ids] == ["train"] * a + ["val"] * b + ["test"] * (n - a - b)


def test_partitions_follow_the_rows(spark, monkeypatch):
    """Many rows get more range partitions than the session has shuffle partitions, and the
    last value (text, some NULL, a key without times) is carried over every cut."""
    from riskfeatures.operators import ranges
    monkeypatch.setattr(ranges, "ROWS", 300)
    t0 = dt.datetime(2020, 5, 5)
    rows = [(i, i % 2 or None, None if i % 2 else t0 + dt.timedelta(seconds=i // 50), f"v{i}" if i % 7 == 0 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, g int, ts timestamp_ntz, v string").repartition(3)
    got = scan(df, ["g"], ["ts", "id"], {"l": ("last", F.col("v")), "n": ("sum", F.lit(1).cast("bigint"))})
    assert partitions(df) == 10 and got.select("part").distinct().count() > ranges.shuffle_partitions(df)
    state, want = {}, {}
    for i, g, _, v in sorted(rows, key=lambda r: r[0]):
        last, n = state.get(g, (None, 0))
        state[g] = want[i] = (v or last, n + 1)
    assert {r.id: (r.l, r.n) for r in got.collect()} == want


def test_totals_are_hashed(spark):
    """No aggregate over all rows sorts them: first times and the parents' pivot have fixed-width
    values; only a cut group's latest rows are compared in full."""
    from riskfeatures.config import AS_OF
    from riskfeatures.operators import cutoffs as cut
    from riskfeatures.plans import features as feat
    from riskfeatures.sources.roles import roles
    from tests.scales import SF_SMALL
    r = roles(spark, SF_SMALL)
    base = cut.base_tasks(r.task, AS_OF).join(r.major_activity.select(F.col("id").alias("_maid"), "kpi_id"), F.col("major_activity_id") == F.col("_maid"), "left")
    first = pit.churn_first_seen(r.sub_task_history, "id", "history_date", "status", ["history_id"])
    for df in (first, feat.parent_pass(r, base)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan
        assert all("key=[part#" in line for line in plan.splitlines() if "SortAggregate" in line)
