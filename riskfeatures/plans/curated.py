"""Curated judgements on features: verdicts and the leakage register."""

# Verdict and reason of every feature that was judged by hand.
FEATURE_VERDICTS = {
    "emp_past_overdue_rate": ("USE", "High signal (r=+0.24), fold-safe with proper CV"),
    "pos_past_overdue_rate": ("USE", "High signal (r=+0.28), fold-safe with proper CV"),
    "dept_past_overdue_rate": ("USE", "Strong dept-level signal, fold-safe with proper CV"),
    "position_id_encoded": ("USE", "Target-encoded, must be fit inside CV folds"),
    "planned_duration": ("USE", "Strong temporal risk feature"),
    "creation_to_planned_start": ("USE", "Retroactive scheduling signal"),
    "num_revisions": ("USE", "Strong revision death spiral signal"),
    "revision_frequency": ("USE", "Normalized revision rate"),
    "subtask_completion_pct_at_halfway": ("USE", "Designed to be cutoff-safe — already marked USE"),
    "kpi_is_overdue_flag": ("USE", "Upstream cascade risk signal"),
    "has_challenges": ("USE", "Operational blocker signal"),
    "num_challenges": ("USE", "Blocker intensity"),
    "is_cross_dept": ("USE", "Structural coordination overhead"),
    "num_kpi_revisions": ("USE", "KPI churn indicator"),
    "num_ma_revisions": ("USE", "Upstream MA process instability"),
    "task_comment_count": ("USE", "Communication paradox signal"),
    "days_since_update": ("USE", "Staleness indicator — fix cutoff date"),
    "created_month": ("USE", "Seasonality — Q4 behavioral fatigue"),
    "created_quarter": ("USE", "Coarse seasonality"),
    "is_planned": ("USE", "Planned vs ad-hoc task risk"),
    "risk_mapping": ("USE", "Domain-assigned risk tier"),
    "kpi_status_ordinal": ("USE", "Upstream KPI health"),
    "has_kpi_potential_challenge": ("USE", "Pre-planned blockers (~12.6% present)"),
    "num_kpi_potential_challenges": ("USE", "Planned blocker intensity"),
    "status_encoded": ("CAUTION", "Post-event leakage risk for completed tasks — use only for in-flight prediction"),
    "subtask_completion_pct": ("CAUTION", "Current state — use _at_halfway variant for strict cutoff models"),
    "subtask_overdue_rate": ("CAUTION", "Current state — may include post-halfway data"),
    "revision_recency": ("CAUTION", "Uses today() — fix cutoff date"),
    "approval_status_encoded": ("CAUTION", "Reflects post-review state, safe for halfway model"),
    "lead_approval_status_encoded": ("CAUTION", "Same as approval_status — second stage signal"),
    "ma_status_encoded": ("CAUTION", "Upstream state, safe at creation time"),
    "ma_approval_status_encoded": ("CAUTION", "Upstream approval state"),
    "has_kpi_challenge": ("CAUTION", "Very sparse (~1.1% present) — keep as precision feature"),
    "num_kpi_challenges": ("CAUTION", "Very sparse — same as above"),
    "has_subtask_challenge": ("CAUTION", "Extremely sparse (~0.2%) — monitor for overfitting"),
    "num_subtask_challenges": ("CAUTION", "Extremely sparse — same as above"),
    "cross_dept_pair_exists": ("CAUTION", "Very sparse (~1.4%) but informative when present"),
    "avg_sub_status_changes": ("CAUTION", "Sparse (~1.6% nonzero) — rework signal when present"),
    "num_subtasks": ("CAUTION", "Current count may include post-halfway subtasks"),
    "has_subtasks": ("CAUTION", "Current state subtask flag"),
    "ma_comment_count": ("AVOID", "DEAD FEATURE: zero MA comments in entire dataset"),
    "created_is_weekend": ("AVOID", "Weak signal — very low overdue rate variance"),
    "created_is_friday": ("AVOID", "Marginal timing signal — low information gain"),
    "created_dow": ("AVOID", "Subsumed by created_month/quarter; DOW effect minimal"),
    "kpi_comment_count": ("AVOID", "Extremely sparse (95% zero), signal subsumed by task_comment_count"),
    "wl_low": ("AVOID", "Baseline dummy in one-hot set — causes dummy trap"),
}

# Leakage risk of features and what to do about it.
LEAK_REGISTER = {
    "status_encoded": ("LEAKAGE RISK", "status=completed is post-event — indicates task already finished"),
    "ma_status_encoded": ("CAUTION", "MA status reflects upstream resolution — fold-safe at creation time"),
    "dept_past_overdue_rate": ("CAUTION", "Must be recomputed inside each training fold — global mean leaks"),
    "emp_past_overdue_rate": ("CAUTION", "Must be recomputed inside each training fold — global mean leaks"),
    "pos_past_overdue_rate": ("CAUTION", "Must be recomputed inside each training fold — global mean leaks"),
    "position_id_encoded": ("CAUTION", "Target-encoded — must be fit on train fold only"),
    "days_since_update": ("CAUTION", "Uses today() — set fixed cutoff date for reproducibility"),
    "revision_recency": ("CAUTION", "Uses today() — same issue as days_since_update"),
    "subtask_completion_pct": ("CAUTION", "Current state — use subtask_completion_pct_at_halfway for strict halfway prediction"),
    "subtask_overdue_rate": ("CAUTION", "Current state — may include post-halfway events"),
    "num_revisions": ("CAUTION", "Current count — must be truncated at prediction cutoff"),
    "kpi_is_overdue_flag": ("SAFE", "KPI-level flag, not task-level — upstream signal only"),
    "ma_comment_count": ("DROP", "Dead feature: confirmed zero MA comments exist in dataset"),
    "planned_duration": ("SAFE", "Known at task creation — no leakage"),
    "creation_to_planned_start": ("SAFE", "Known at task creation — no leakage"),
    "risk_mapping": ("SAFE", "Domain-assigned at creation"),
    "is_cross_dept": ("SAFE", "Structural flag set at creation"),
    "is_planned": ("SAFE", "Administrative flag set at creation"),
    "has_kpi_potential_challenge": ("SAFE", "Planned challenges — known pre-execution"),
    "subtask_completion_pct_at_halfway": ("SAFE", "Designed to be cutoff-safe — computed at theoretical midpoint"),
}
