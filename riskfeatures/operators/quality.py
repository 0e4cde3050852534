"""Data-quality checks as one report frame (check_name, status, detail).

Checks on the same table are fused into a single aggregate pass (one scan of
``task`` answers all null/dup/range checks); only genuinely different inputs
(history tables, anti joins) add scans.  The report is a tiny union of
one-row frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import sql_round


def status_when(ok: Column, fail: str = "FAIL") -> Column:
    return F.when(ok, "PASS").otherwise(fail)


def pct1(x: Column) -> Column:
    """'%.1f' of a percentage (PostgreSQL format('%.1f') rounds half away from zero)."""
    return F.format_string("%.1f", sql_round(x, 1))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent: a left anti join (not
    LEFT JOIN ... IS NULL), NULL keys dropped first (null-safe NOT IN)."""
    c = child.filter(F.col(child_key).isNotNull())
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return c.join(p, c[child_key] == p["_pk"], "left_anti")


def row(name: str, status: Column, detail: Column) -> list[Column]:
    return [F.lit(name).alias("check_name"), status.alias("status"), detail.alias("detail")]
