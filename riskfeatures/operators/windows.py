"""Window operators that stay distributed on low-cardinality keys: running values
come from ``ranges.scan``, so neither a department with a third of all rows nor one
bulk-import day of it lands in one task.  NULL groups are kept and matched
null-safely, like SQL ``PARTITION BY``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import scan


def expanding_mean(df: DataFrame, group: str | Sequence[str], ts: str, tie: str, values: Sequence[str],
                   out: Sequence[str] | None = None, keep: Sequence[str] = ("id",),
                   with_count: str | None = None) -> DataFrame:
    """Self-excluding expanding mean of ``values`` per ``group`` in (ts, tie) order:
    ``AVG(v) OVER (PARTITION BY g ORDER BY ts, tie ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING)``, and the number of earlier rows."""
    out = list(out or [f"{v}_expanding_mean" for v in values])
    group = [group] if isinstance(group, str) else list(group)
    needed = dict.fromkeys([*keep, *group, ts, tie, *values])
    running = {"_rows": ("sum", F.lit(1).cast("bigint"))}
    for i, v in enumerate(values):
        running[f"_s{i}"] = ("sum", F.col(v).cast("double"))
        running[f"_c{i}"] = ("sum", F.when(F.col(v).isNotNull(), 1).otherwise(0).cast("bigint"))
    got = scan(df.select(*needed), group, [ts, tie], running, inclusive=False, name="expanding")
    cols = [F.col(k) for k in keep]
    cols += [F.when(F.col(f"_c{i}") > 0, F.col(f"_s{i}") / F.col(f"_c{i}")).alias(o) for i, o in enumerate(out)]
    if with_count:
        cols.append(F.col("_rows").cast("bigint").alias(with_count))
    return got.select(*cols)


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """DISTINCT ON (key) ... ORDER BY order: row_number()=1 (Spark plans a
    partial WindowGroupLimit before the shuffle, so only one row per key and
    map partition crosses the network)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def global_row_number(df: DataFrame, order: Sequence[str], out: str = "row_num") -> DataFrame:
    """Row number over the whole frame, in ``order``."""
    return scan(df, [], list(order), {out: ("sum", F.lit(1).cast("bigint"))}, name="numbered").drop("part")
