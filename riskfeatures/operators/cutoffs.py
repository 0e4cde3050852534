"""Base task extraction and prediction cutoffs (creation, halfway)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AS_OF
from ..functions.scalar import sql_round
from ..functions.temporal import (as_ts, calendar_parts, date_days, floor_days,
                                  halfway_cutoff, lit_date, midpoint_date,
                                  midpoint_fractional)


def dated(task: DataFrame) -> DataFrame:
    """Not-null date guard (rows the features are defined on)."""
    return task.filter(F.col("start_date").isNotNull() & F.col("end_date").isNotNull())


def base_tasks(task: DataFrame, as_of=AS_OF) -> DataFrame:
    """One row per dated task with static temporal features and both cutoffs."""
    t = dated(task)
    return t.select(
        "id", "status", "approval_status", "lead_approval_status", "weight_level",
        F.col("is_planned").cast("int").alias("is_planned"), "risk_mapping",
        "start_date", "end_date", "actual_end_date", "created_date", "updated_date",
        "major_activity_id", "position_id", "department_id",
        F.col("derived_from_cross_department_assignment_id").isNotNull().cast("int")
        .alias("is_cross_dept"),
        F.col("derived_from_cross_department_assignment_id"),
        date_days("end_date", "start_date").alias("planned_duration"),
        floor_days("start_date", "created_date").alias("creation_to_planned_start"),
        *calendar_parts("created_date"),
        floor_days(lit_date(as_of), F.to_date("updated_date")).alias("days_since_update_halfway"),
        as_ts("created_date").alias("creation_cutoff"),
        halfway_cutoff("created_date", "start_date", "end_date").alias("halfway_cutoff"),
    )


def cutoffs_long(base: DataFrame) -> DataFrame:
    """(id, checkpoint, cutoff_ts): one row per task and checkpoint (narrow, no shuffle)."""
    return base.select(
        "id", F.expr("stack(2, 'creation', creation_cutoff, 'halfway', halfway_cutoff)")
        .alias("checkpoint", "cutoff_ts"))


def midpoints(task: DataFrame) -> DataFrame:
    """Uncapped integer midpoint and the fractional-day variant."""
    t = dated(task)
    return t.select("id", midpoint_date("start_date", "end_date").alias("midpoint_date"),
                    midpoint_fractional("start_date", "end_date").alias("midpoint_ts"),
                    halfway_cutoff("created_date", "start_date", "end_date").alias("halfway_cutoff"))


def cutoff_audit(base: DataFrame) -> DataFrame:
    """Retroactive share, midpoint-before-creation count, cutoff ranges (one row)."""
    mid = as_ts(midpoint_date("start_date", "end_date"))
    return base.agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(F.col("start_date") < F.to_date("created_date")).alias("n_retroactive"),
        sql_round(F.avg((F.col("start_date") < F.to_date("created_date")).cast("int")) * 100, 6)
        .alias("pct_retroactive"),
        F.count_if(mid < F.col("created_date")).alias("n_midpoint_before_creation"),
        F.min("creation_cutoff").alias("min_creation_cutoff"),
        F.max("creation_cutoff").alias("max_creation_cutoff"),
        F.min("halfway_cutoff").alias("min_halfway_cutoff"),
        F.max("halfway_cutoff").alias("max_halfway_cutoff"),
    )
