"""Golden literals replayed from the reference's unit tests (FIXTURES.md §3)."""

import datetime as dt

from pyspark.sql import functions as F

from riskfeatures.config import STATUS_ORDER
from riskfeatures.functions import encode as enc
from riskfeatures.functions.scalar import ordinal, right_closed_bin
from riskfeatures.functions.temporal import calendar_parts, date_days, floor_days, halfway_cutoff, midpoint_date


def test_planned_duration(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 5))], ["s", "e"])
    assert df.select(date_days("e", "s").alias("d")).first().d == 4


def test_midpoint(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 11))], ["s", "e"])
    assert df.select(midpoint_date("s", "e").alias("m")).first().m == dt.date(2024, 1, 6)


def test_midpoint_negative_truncates_toward_zero(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 10), dt.date(2024, 1, 7))], ["s", "e"])
    # (7 - 10) DIV 2 = -1 (truncation, like integer division in SQL)
    assert df.select(midpoint_date("s", "e").alias("m")).first().m == dt.date(2024, 1, 9)


def test_halfway_never_before_creation(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 20, 10), dt.date(2024, 1, 1), dt.date(2024, 1, 11))],
                               ["c", "s", "e"])
    assert df.select(halfway_cutoff("c", "s", "e").alias("h")).first().h == dt.datetime(2024, 1, 20, 10)


def test_weekend_friday_monday0(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6, 9),), (dt.datetime(2024, 1, 5, 9),)], ["c"])
    rows = df.select(*calendar_parts("c")).collect()
    assert rows[0].created_is_weekend == 1 and rows[0].created_dow == 5
    assert rows[1].created_is_friday == 1 and rows[1].created_is_weekend == 0


def test_floor_days_negative(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 12), dt.date(2024, 1, 2))], ["c", "s"])
    # start - created = -0.5 day -> floor = -1 (pandas .dt.days), not 0
    assert df.select(floor_days("s", "c").alias("d")).first().d == -1


def test_ordinal_fallback(spark):
    df = spark.createDataFrame([("not_started",), ("completed",), ("weird",), (None,)], "s string")
    got = [r.o for r in df.select(ordinal("s", STATUS_ORDER).alias("o")).collect()]
    assert got == [0, 2, 1, 1]


def test_target_encode(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], ["g", "y"])
    got = {r.g: r.te for r in enc.target_encode(df, "g", "y", "te").collect()}
    assert got == {"a": 0.5, "b": 1.0}


def test_fill_zero_and_mean(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    assert [r.x for r in enc.fill_zero(df, ["x"]).collect()] == [1.0, 0.0, 3.0]
    assert sorted(r.x for r in enc.fill_mean(df, ["x"]).collect()) == [1.0, 2.0, 3.0]


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(-0.001,), (0.0,), (0.1,), (0.1000001,), (1.0,), (1.5,)], "x double")
    edges, labels = (-0.001, 0.1, 0.2, 0.3, 1.0), ("a", "b", "c", "d")
    got = [r.b for r in df.select(right_closed_bin("x", edges, labels).alias("b")).collect()]
    assert got == [None, "a", "a", "b", "d", None]
