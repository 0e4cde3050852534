"""Property tests: the distributed PIT / window operators equal brute force."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskfeatures.operators import pit
from riskfeatures.operators.windows import expanding_mean, global_row_number


def _rand_events(seed, n_keys=3, n_ev=120, n_cut=60):
    rnd = random.Random(seed)
    t0 = dt.datetime(2020, 1, 1)
    ev = [(rnd.randrange(n_keys), t0 + dt.timedelta(hours=rnd.randrange(24 * 6)), i, rnd.choice("abc"))
          for i in range(n_ev)]
    # include cutoffs exactly at event timestamps (ties: events count, ts <= cutoff)
    cu = [(j, rnd.choice([None, *range(n_keys)]), rnd.choice(ev)[1] if j % 3 == 0
           else t0 + dt.timedelta(hours=rnd.randrange(24 * 6))) for j in range(n_cut)]
    return ev, cu


def test_pit_merge_equals_bruteforce(spark):
    for seed in (1, 2, 3):
        ev, cu = _rand_events(seed)
        e = spark.createDataFrame(ev, "k int, ts timestamp_ntz, seq int, v string")
        c = spark.createDataFrame(cu, "cid int, k int, cts timestamp_ntz")
        got = {r.cid: (r.pit_n, r.pit_last_ts, r.pit_last["v"] if r.pit_last else None)
               for r in pit.pit_merge(e, c, "k", "k", "ts", "cts", seq=["seq"], values=["v"],
                                      carry=["cid"]).collect()}
        for cid, k, cts in cu:
            hits = sorted([x for x in ev if x[0] == k and x[1] <= cts], key=lambda x: (x[1], x[2]))
            exp = (len(hits), hits[-1][1] if hits else None, hits[-1][3] if hits else None)
            assert got[cid] == exp, (seed, cid)


def test_expanding_mean_equals_plain_window(spark):
    rnd = random.Random(5)
    t0 = dt.datetime(2021, 3, 1)
    rows = [(i, rnd.choice([None, 1, 2]), t0 + dt.timedelta(hours=rnd.randrange(200)), rnd.randrange(2),
             rnd.choice([None, 1.0, 2.0, 5.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g int, ts timestamp_ntz, y int, v double")
    got = {r.id: (r.y_m, r.v_m, r.n) for r in
           expanding_mean(df, "g", "ts", "id", ["y", "v"], ["y_m", "v_m"], with_count="n").collect()}
    w = Window.partitionBy("g").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    ref = {r.id: (r.y_m, r.v_m, r.n) for r in df.select(
        "id", F.avg("y").over(w).alias("y_m"), F.avg("v").over(w).alias("v_m"),
        F.count(F.lit(1)).over(w).alias("n")).collect()}
    assert got.keys() == ref.keys()
    for k in ref:
        for a, b in zip(got[k], ref[k]):
            assert (a is None and b is None) or abs(a - b) < 1e-9, k


def test_global_row_number(spark):
    rows = [(i, i % 4, (i * 7) % 13) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, q int, m int")
    got = sorted((r.row_num, r.id) for r in global_row_number(df, ["q", "m", "id"]).collect())
    exp = [(n + 1, r[0]) for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2], r[0])))]
    assert got == exp


def test_churn_first_seen(spark):
    rows = [(1, dt.datetime(2020, 1, d), s, d) for d, s in [(1, "a"), (2, "b"), (3, "a"), (4, "c")]]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, st string, hid int")
    got = {r.st: r.ts.day for r in pit.churn_first_seen(df, "id", "ts", "st", ["hid"]).collect()}
    assert got == {"a": 1, "b": 2, "c": 4}
