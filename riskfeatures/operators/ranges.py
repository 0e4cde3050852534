"""Running values over sorted groups of any size: range partitions with offsets.

A window over a whole group puts a hot group (one department, one bulk-import day)
into one task.  ``scan`` sorts by (group, order) into range partitions, whose sampled
splitters cut a hot group, a hot day or a bunch of scores wherever they are, and adds
two levels up: the running value inside (partition, group), and the group's total over
the partitions before.  A splitter cuts one group at most, so the second level has
fewer rows than there are partitions and is broadcast.  The partitioned rows are
written to the shared folder first, so both levels see the same splitters, also
after an executor is lost; but for small frames they are written in buckets, one a
range partition, so the window reads them where they lie, without a second exchange.
The number of partitions follows the rows, so that a partition's sort stays in memory,
and totals are aggregates of fixed-width values (hashed, not sorted); the ``last`` of a
group is sought only in groups that a splitter cuts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import free_shuffles, stored_buckets, stored_table


ROWS = 2_000_000    # rows that a range partition should not exceed
BUCKETED = 100_000  # rows from which range partitions are written as buckets


def shuffle_partitions(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def partitions(df: DataFrame, n_rows: int | None = None) -> int:
    """The session's number of shuffle partitions, or more for many rows."""
    return max(shuffle_partitions(df), -(-(df.count() if n_rows is None else n_rows) // ROWS))


_NUMBERS: dict[int, list[int]] = {}


def part_numbers(spark: SparkSession, n: int) -> list[int]:
    """``n`` ascending numbers that fall into ``n`` different buckets."""
    if n not in _NUMBERS:
        k = F.col("id").cast("int")
        first = spark.range(20 * n + 20).groupBy(F.pmod(F.hash(k), F.lit(n)).alias("bucket")).agg(F.min(k).alias("k"))
        _NUMBERS[n] = sorted(r.k for r in first.collect())
    return _NUMBERS[n]


def scan(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], running: dict[str, tuple[str, Column]],
         inclusive: bool = True, name: str = "ranges") -> DataFrame:
    """``df`` (stored) with ``part``, its range partition, and one column per entry of
    ``running``: the ``sum``, ``max`` or ``last`` non-NULL value of an expression over
    the group's rows up to the row (``inclusive``) or before it.  NULL is a group of its
    own; without ``group`` all rows are one group.  ``order`` must not leave ties whose
    order matters, and is ascending where a ``last`` is asked for."""
    group, order = list(group), [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [*[F.col(g) for g in group], *order]
    n_rows = df.count()
    n_parts = partitions(df, n_rows)
    ranged, i = df.repartitionByRange(n_parts, *keys), F.spark_partition_id()
    if n_rows < BUCKETED:
        rows = stored_table(ranged.withColumn("part", i), name)
        moved = rows.repartition("part", *group)
    else:
        numbers = part_numbers(df.sparkSession, n_parts)
        part = F.coalesce(F.get(F.lit(numbers), i), i + (numbers[-1] + 1))  # ascending
        moved = rows = stored_buckets(ranged.withColumn("part", part), name, "part", n_parts)
        free_shuffles(df.sparkSession)

    inside = Window.partitionBy("part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    parts = Window.partitionBy(*group).orderBy("part")
    before = parts.rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    totals = rows.groupBy("part", *group).agg(F.count(F.lit(1)).alias("_counted"), *[over[kind](e).alias(n) for n, (kind, e) in running.items() if kind != "last"])
    cut = totals.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(*group))).where("_parts > 1").drop("_parts", "_counted")
    if any(kind == "last" for kind, _ in running.values()):
        cut = stored_table(cut, f"{name}-cut")  # a row per splitter, read by each pass below
        for n, (kind, e) in running.items():
            if kind == "last":
                cut = _matched(cut, _last_totals(rows, cut, group, order, e, n), ["part", *group], "left")
    offsets = cut.select("part", *group, F.row_number().over(parts).alias("_nth"), *[over[kind](n).over(before).alias(f"_p{n}") for n, (kind, _) in running.items()])
    offsets = offsets.where("_nth > 1").drop("_nth")
    offsets = offsets.select(F.col("part").alias("_part"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[f"_p{n}" for n in running])

    # running expressions are taken behind the exchange: rows move by their own columns
    here = moved.withColumns({f"_w{n}": over[kind](e).over(inside) for n, (kind, e) in running.items()})
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("part") == F.col("_part"))
    both = here.join(F.broadcast(offsets), same, "left")

    def added(n: str, kind: str) -> Column:
        w, p = F.col(f"_w{n}"), F.col(f"_p{n}")
        if kind == "sum":
            return F.coalesce(w, F.lit(0)) + F.coalesce(p, F.lit(0))
        return F.greatest(w, p) if kind == "max" else F.coalesce(w, p)
    return both.select(*df.columns, "part", *[added(n, kind).alias(n) for n, (kind, _) in running.items()])


def _matched(df: DataFrame, few: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the columns of the broadcast ``few`` that has the same ``keys``; NULL equals NULL."""
    few = few.withColumnsRenamed({k: f"_few_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_few_{k}")) for k in keys[1:]], F.col(keys[0]) == F.col(f"_few_{keys[0]}"))
    return df.join(F.broadcast(few), same, how).drop(*[f"_few_{k}" for k in keys])


def _last_totals(rows: DataFrame, cut: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """The latest non-NULL ``value`` of every (part, group) in ``cut``: first the latest first
    order column, then the rows that have it in full order."""
    keys = ["part", *group]
    known = _matched(rows.withColumns({"_value": value, "_o": order[0]}).where("_value is not null"), cut.select(*keys), keys)
    newest = known.groupBy(*keys).agg(F.max("_o").alias("_newest"))
    at = _matched(known, newest, keys).where(F.col("_o").eqNullSafe(F.col("_newest")))
    return at.groupBy(*keys).agg(F.max_by("_value", F.struct(*order)).alias(out))
