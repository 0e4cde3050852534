"""Fixed values that results depend on.

These are domain constants of the modelled process (status vocabularies,
ordinal codes, bin edges, thresholds).  They are plain data so a user can pass
their own; functions take them as parameters with these as defaults.
"""

from __future__ import annotations

import datetime as _dt

# ---- fixed values: evaluation date ------------------------------------------
# The fixture data ends in 1998; this date plays the role of "today" for
# labels and recency features.  Never use current_date() in a feature.
AS_OF = _dt.date(1999, 6, 30)

# ---- fixed values: status vocabularies and ordinal codes --------------------
CLOSED_STATUSES = ("completed", "terminated", "archived")
STATUS_ORDER = {"not_started": 0, "ongoing": 1, "in_progress": 1, "completed": 2,
                "terminated": 3, "archived": 4}
APPROVAL_ORDER = {"pending": 0, "in_review": 1, "approved": 2, "rejected": 3}
MA_STATUS_ORDER = {"not_started": 0, "ongoing": 1, "completed": 2, "terminated": 3}
KPI_STATUS_ORDER = {"not_started": 0, "ongoing": 1, "completed": 2, "terminated": 3,
                    "archived": 4}
ORDINAL_FALLBACK = 1

# ---- fixed values: comment content types (polymorphic FK) -------------------
CONTENT_TYPE = {"milestone": 21, "kpi": 22, "major_activity": 23, "task": 24}

# ---- fixed values: bins and labels ------------------------------------------
DEPT_RISK_BINS = (-0.001, 0.10, 0.20, 0.30, 1.0)
DEPT_RISK_LABELS = ("Low Risk (0-10%)", "Moderate (10-20%)", "High (20-30%)",
                    "Critical (>30%)")
REVISION_BUCKETS = ("0", "1", "2", "3+")
RISK_BADGE = ((0.35, "Critical Risk"), (0.20, "High Risk"), (0.10, "Moderate Risk"))
GAUGE_BANDS = (20.0, 35.0)

# ---- fixed values: checkpoint column maps (creation / halfway datasets) -----
STATIC_COLS = (
    "id", "calculated_overdue", "target_source",
    "planned_duration", "creation_to_planned_start",
    "created_dow", "created_is_weekend", "created_is_friday",
    "created_month", "created_quarter",
    "is_planned", "risk_mapping", "is_cross_dept", "cross_dept_pair_exists",
    "dept_past_overdue_rate", "dept_avg_revisions",
    "emp_past_overdue_rate", "pos_past_overdue_rate",
)
DUAL_FEATURES = (
    "status_encoded", "approval_status_encoded", "lead_approval_status_encoded",
    "ma_status_encoded", "ma_approval_status_encoded", "num_ma_revisions",
    "kpi_is_overdue_flag", "kpi_status_ordinal", "num_kpi_revisions",
    "num_revisions", "revision_frequency", "revision_recency",
    "num_subtasks", "has_subtasks", "subtask_completion_pct", "subtask_overdue_rate",
    "task_comment_count", "avg_sub_status_changes",
)
# The halfway dataset adds two columns; kpi_comment_count (creation only) stays
# in the wide table but is not part of either checkpoint dataset.
HALFWAY_EXTRA = (("days_since_update", "days_since_update_halfway"),
                 ("subtask_completion_pct_at_halfway", "subtask_completion_pct_at_halfway"))
