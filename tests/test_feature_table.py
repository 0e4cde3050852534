"""The feature table's shared steps on rows of their own: what moves, and equal results."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from riskfeatures.operators import pit
from riskfeatures.operators.ranges import scan
from riskfeatures.plans import features as feat

T0 = dt.datetime(2020, 1, 1)


def _day(n):
    return None if n is None else T0 + dt.timedelta(days=n)


def _roles(spark):
    sub = [(t * 10 + i if i else None, t, _day(t + i), "completed" if i % 2 else ("ongoing" if i else None), i == 2) for t in range(1, 6) for i in range(4)]
    hist = [(t * 10 + i, _day(d), d or 0, s) for t in range(1, 5) for i in (1, 2)
            for d, s in ((i, "a"), (i + 3, "a"), (t + 4, "b"), (9, None), (None, "c") if t == 2 else (30, "c"))]
    return SimpleNamespace(
        sub_task=spark.createDataFrame([*sub, (99, None, T0, "completed", True)], "id long, task_id long, created_date timestamp_ntz, status string, is_overdue boolean"),
        sub_task_history=spark.createDataFrame(hist + [(None, T0, 1, "a"), (7, T0, 1, "a")], "id long, history_date timestamp_ntz, history_id long, status string"))


def test_subtask_pass_equals_features_and_churn(spark):
    """One move of the subtasks gives both branches' columns, also for a task that comes twice,
    one without subtasks' history, and NULL times, statuses and ids."""
    r = _roles(spark)
    base = spark.createDataFrame([(1, _day(2), _day(6)), (2, _day(5), _day(8)), (2, _day(5), _day(8)), (3, _day(4), None), (4, _day(6), _day(40)), (4, _day(1), _day(9)),
                                  (5, _day(3), _day(9)), (6, _day(3), _day(9)), (None, _day(3), _day(9))],
                                 "id long, creation_cutoff timestamp_ntz, halfway_cutoff timestamp_ntz")
    got = feat.subtask_pass(r, base)
    want = feat.subtask_features(r, base).join(feat.subtask_churn(r, base), "_tid", "left")
    rows = lambda df: sorted(tuple(x) for x in df.select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in sorted(want.columns)]).collect())
    assert rows(got) == rows(want) and got.count() == 5


def test_scan_moves_its_rows_only(spark):
    """What is stored and exchanged are the frame's own columns: running expressions are taken
    behind the exchange."""
    df = spark.createDataFrame([(i % 3, i, float(i)) for i in range(300)], "g int, i int, v double")
    got = scan(df, ["g"], ["i"], {"s": ("sum", F.col("v") * 2), "l": ("last", F.when(F.col("v") > 9, F.col("i")))})
    plan = got._jdf.queryExecution().executedPlan().toString()
    read = [line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line]
    assert read[0] == "struct<g:int,i:int,v:double,part:int>"
    want, state = {}, {}
    for i in range(300):
        s, last = state.get(i % 3, (0.0, None))
        state[i % 3] = want[i] = (s + 2.0 * i, i if i > 9 else last)
    assert {r.i: (r.s, r.l) for r in got.collect()} == want


def test_two_kinds_of_events_share_a_key(spark):
    """Both counts, and the last state of any event, as of cutoffs; ties count, other keys do not."""
    ev = spark.createDataFrame([(1, 0, _day(1), 1, "x"), (1, 1, _day(1), 2, "y"), (1, 1, _day(3), 3, "z"), (2, 0, _day(2), 4, None), (1, 0, None, 5, "n")],
                               "_k long, _kind int, _ts timestamp_ntz, s int, v string").select("_k", "_kind", "_ts", F.struct("s").alias("_seq"), F.struct("v").alias("_v"))
    cu = spark.createDataFrame([(1, _day(0), 10), (1, _day(1), 11), (1, _day(5), 12), (2, _day(5), 13), (None, _day(5), 14)], "_k long, _ts timestamp_ntz, id int")
    got = pit.pit_merge_frames(ev, cu, ["id", "_k"]).collect()
    assert {x.id: (x._k, x.pit_n, x.pit_n1) for x in got} == {10: (1, 0, 0), 11: (1, 1, 1), 12: (1, 1, 2), 13: (2, 1, 0), 14: (None, 0, 0)}


def test_stored_base_holds_codes(spark):
    """The labelled base that seven branches read is narrow: no status texts, no snapshots."""
    from riskfeatures.sources.roles import roles
    from tests.scales import SF_SMALL
    from riskfeatures.session import stored_table
    kept = {}

    def store(df, name):
        kept[name] = df.dtypes
        return stored_table(df, name)
    feat.leak_free_wide(roles(spark, SF_SMALL), store=store)
    assert [c for c, kind in kept["labelled-base"] if "string" in kind or "struct" in kind] == ["target_source"]


def test_scan_window_reads_rows_where_they_lie(spark, monkeypatch):
    """The stored range partitions are buckets: the window over them needs no exchange, and
    their numbers ascend with the ranges."""
    from riskfeatures.operators import ranges
    monkeypatch.setattr(ranges, "BUCKETED", 0)
    df = spark.createDataFrame([(i % 3 or None, i, float(i)) for i in range(300)], "g int, i int, v double")
    running = {"s": ("sum", F.col("v")), "l": ("last", F.when(F.col("v") % 7 == 0, F.col("i"))), "m": ("max", F.col("v") % 50)}
    got = scan(df, ["g"], ["i"], running)
    plan = got._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan
    monkeypatch.setattr(ranges, "BUCKETED", 1000)
    both = [sorted(tuple(r) for r in x.drop("part").fillna(-1).collect()) for x in (got, scan(df, ["g"], ["i"], running))]
    assert both[0] == both[1]
    got = got.fillna(-1)
    parts = got.groupBy("part").agg(F.min(F.struct("g", "i")).alias("a"), F.max(F.struct("g", "i")).alias("b")).orderBy("part").collect()
    assert len(parts) > 1 and all(p.b < q.a for p, q in zip(parts, parts[1:]))


def test_part_numbers_fall_into_different_buckets(spark):
    from riskfeatures.operators.ranges import part_numbers
    for n in (1, 2, 24, 200):
        got = part_numbers(spark, n)
        rows = spark.createDataFrame([(k,) for k in got], "k int").select(F.pmod(F.hash("k"), F.lit(n)).alias("b")).distinct().count()
        assert got == sorted(got) and len(got) == rows == n


def test_branches_join_the_stored_base_where_it_lies(spark, monkeypatch):
    """The labelled base is stored in buckets of the task id; the final join does not move it."""
    from riskfeatures.sources.roles import roles
    from tests.scales import SF_SMALL
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = feat.leak_free_wide(roles(spark, SF_SMALL), store=feat.stored_by_id)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    wide = [i for i, line in enumerate(lines) if "labelled_base" in line and "calculated_overdue" in line and "subtask" not in line and "num_revisions_at_creation" in line]
    assert wide and all("Bucketed: true" in lines[i] and "Exchange" not in lines[i - 1] and "Exchange" not in lines[i - 2] for i in wide)


def test_current_rows_are_joined_once(spark):
    """The means and the encoding of the as-of-now table read its stored rows, and the joins by
    the task id stand together, last."""
    from riskfeatures.session import stored_table
    from riskfeatures.sources.roles import roles
    from tests.scales import SF_SMALL
    kept = {}

    def store(df, name):
        kept[name] = df._jdf.queryExecution().executedPlan().toString().splitlines()
        return stored_table(df, name)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = feat.current_wide(roles(spark, SF_SMALL), store=store)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "lineitem.parquet" not in plan and "orders.parquet" not in plan
    joins = [line.strip(" :+-").split("[")[1].split("#")[0] for line in kept["current-rows"] if "SortMergeJoin" in line and "LeftOuter" in line]
    assert joins[:6] == ["id"] * 6
