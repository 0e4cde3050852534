"""Outcome labels with provenance.

Three-tier label (completion date = actual end, else first completion seen in
history, else last update), two-tier label used inside historical aggregates,
and the early "v1" label without fallbacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AS_OF, CLOSED_STATUSES
from ..functions.temporal import lit_date


def first_event(history: DataFrame, key: str, ts: str, cond: Column,
                out_key: str = "task_id", out_col: str = "first_completed_at",
                as_date: bool = True) -> DataFrame:
    """MIN(ts) per key over events matching ``cond`` (partial aggregation,
    so a hot key never gathers its rows in one task)."""
    v = F.min(ts)
    v = F.to_date(v) if as_date else v
    return (history.filter(cond & F.col(key).isNotNull())
            .groupBy(F.col(key).alias(out_key)).agg(v.alias(out_col)))


def first_completed(task_history: DataFrame) -> DataFrame:
    return first_event(task_history, "history_relation_id", "history_date",
                       F.col("status") == "completed")


# Provenance names, in the order in which a completion date is sought.
SOURCES = ("actual_end_date", "history_completion", "updated_date")


def _overdue(status: Column, finished: Column, end_date: Column, as_of) -> Column:
    """A completed task by its completion date, an open one by ``as_of``; NULL dates are not late."""
    late = F.when(status == "completed", finished > end_date).when(~status.isin(*CLOSED_STATUSES), end_date < lit_date(as_of))
    return F.coalesce(late, F.lit(False)).cast("int")


def three_tier(status="status", actual_end="actual_end_date", end="end_date",
               updated="updated_date", first_done="first_completed_at",
               as_of=AS_OF) -> tuple[Column, Column]:
    """Return (calculated_overdue INT, target_source STRING) columns: the completion
    date is the first known of the three dates, its name the provenance."""
    dates = [F.col(actual_end), F.col(first_done), F.to_date(F.col(updated))]
    used = F.coalesce(*[F.when(d.isNotNull(), F.lit(n)) for d, n in zip(dates, SOURCES)], F.lit(SOURCES[-1]))
    label = _overdue(F.col(status), F.coalesce(*dates), F.col(end), as_of)
    source = F.when(F.col(status) == "completed", used).when(label == 1, "open_task").otherwise("status_based")
    return label, source


def two_tier(status="status", actual_end="actual_end_date", end="end_date",
             updated="updated_date", as_of=AS_OF) -> Column:
    """Label used inside the expanding aggregates (no history tier)."""
    return _overdue(F.col(status), F.coalesce(F.col(actual_end), F.to_date(F.col(updated))), F.col(end), as_of)


def v1_label(status="status", actual_end="actual_end_date", end="end_date",
             as_of=AS_OF) -> Column:
    """Earliest label: late completion by actual end date, or open past end."""
    return _overdue(F.col(status), F.col(actual_end), F.col(end), as_of)


def with_three_tier(base: DataFrame, task_history: DataFrame, as_of=AS_OF) -> DataFrame:
    """Attach first completion + three-tier label/provenance to ``base``."""
    fc = first_completed(task_history)
    out = base.join(fc, base["id"] == fc["task_id"], "left").drop("task_id")
    label, source = three_tier(as_of=as_of)
    return out.withColumn("calculated_overdue", label).withColumn("target_source", source)
