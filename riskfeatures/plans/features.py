"""Wide feature tables.

``leak_free_wide``: one row per dated task; every dynamic feature computed as
of the task's creation and halfway cutoffs.  ``current_wide``: the as-of-now
(leaky) variant.  ``checkpoint_dataset`` projects the dual table to the
per-checkpoint training dataset.  All lazy — one logical plan, no action.

Shuffle budget (dominant inputs are the history/event tables):
  * task_history is read once: revision counts, last revision and the status
    snapshot at both cutoffs come from one join + one partial aggregate;
  * shared-key histories (MA, KPI, MA comments) use ``pit_merge`` — linear,
    no events x tasks pairs even on a hot KPI;
  * unique-key children (subtasks, task comments) use join + filtered counts; subtasks
    move to their task once, with the first times of their statuses;
  * expanding group rates come from one range scan (no single-group task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import (APPROVAL_ORDER, AS_OF, CONTENT_TYPE, DUAL_FEATURES, HALFWAY_EXTRA,
                      KPI_STATUS_ORDER, MA_STATUS_ORDER, STATIC_COLS, STATUS_ORDER)
from ..functions.scalar import ordinal, safe_ratio
from ..functions.temporal import lit_date
from ..operators import cutoffs as cut
from ..operators import labels as lbl
from ..operators import pit
from ..operators.ranges import shuffle_partitions
from ..operators.windows import expanding_mean
from ..session import forget, free_shuffles, stored_buckets

CUTS = (("creation", "creation_cutoff"), ("halfway", "halfway_cutoff"))


def labelled_base(r, as_of=AS_OF) -> DataFrame:
    base = cut.base_tasks(r.task, as_of)
    return lbl.with_three_tier(base, r.task_history, as_of)


def task_history_features(r, base: DataFrame) -> DataFrame:
    """One pass over task history: counts, last revision, status snapshot."""
    th = r.task_history
    b = base.select(F.col("id").alias("_tid"), "creation_cutoff", "halfway_cutoff")
    snap = F.struct("status", "approval_status", "lead_approval_status")
    aggs = []
    for name, c in CUTS:
        aggs += [pit.count_upto("history_date", c).alias(f"num_revisions_at_{name}"),
                 pit.max_upto("history_date", c).alias(f"last_revision_at_{name}"),
                 pit.latest_upto(snap, "history_date", ["history_id"], c).alias(f"_snap_{name}")]
    return pit.pit_join_agg(th, b, th["history_relation_id"] == b["_tid"], ["_tid"], aggs)


def subtask_features(r, base: DataFrame) -> DataFrame:
    st = r.sub_task
    b = base.select(F.col("id").alias("_tid"), "creation_cutoff", "halfway_cutoff")
    aggs = []
    for name, c in CUTS:
        aggs += [pit.count_upto("created_date", c).alias(f"num_subtasks_at_{name}"),
                 pit.count_upto("created_date", c, F.col("status") == "completed")
                 .alias(f"num_completed_at_{name}"),
                 pit.count_upto("created_date", c, F.col("is_overdue"))
                 .alias(f"num_overdue_at_{name}")]
    return pit.pit_join_agg(st, b, st["task_id"] == b["_tid"], ["_tid"], aggs)


def subtask_churn(r, base: DataFrame) -> DataFrame:
    """AVG over a task's subtasks of COUNT(DISTINCT status) as of each cutoff."""
    first = pit.churn_first_seen(r.sub_task_history, "id", "history_date", "status", ["history_id"])
    st = r.sub_task.select(F.col("id").alias("_sid"), F.col("task_id"))
    b = base.select(F.col("id").alias("_tid"), "creation_cutoff", "halfway_cutoff")
    per_sub = (first.join(st, first["id"] == st["_sid"])
               .join(b, F.col("task_id") == b["_tid"])
               .groupBy("_tid", "_sid")
               .agg(*[pit.count_upto("history_date", c).alias(f"_n_{n}") for n, c in CUTS]))
    return per_sub.groupBy("_tid").agg(
        *[F.avg(f"_n_{n}").alias(f"avg_sub_status_changes_at_{n}") for n, _ in CUTS])


def subtask_pass(r, base: DataFrame, step=None) -> DataFrame:
    """``subtask_features`` and ``subtask_churn`` by one move of the subtasks to their task: a
    subtask takes its first times (one per status) along, and they are compared with the
    cutoffs there.  A task that ``base`` has several times counts its subtasks as often.  ``step`` (of
    a frame, a name and its key) stores the first times before the subtasks move."""
    first = pit.churn_first_seen(r.sub_task_history, "id", "history_date", "status", ["history_id"])
    seen = first.groupBy(F.col("id").alias("_hid")).agg(F.collect_list("history_date").alias("_seen"))
    if step is not None:
        seen = step(seen, "first-times", "_hid")
    st = r.sub_task.select("id", "task_id", "created_date", (F.col("status") == "completed").alias("_done"), F.col("is_overdue").alias("_late"))
    st = st.join(seen, F.col("id") == F.col("_hid"), "left").drop("id", "_hid")
    b = base.select(F.col("id").alias("_tid"), "creation_cutoff", "halfway_cutoff")
    b = b.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy("_tid")))
    aggs = []
    for name, c in CUTS:
        upto = F.expr(f"size(filter(_seen, ts -> ts <= {c}))")
        aggs += [pit.count_upto("created_date", c).alias(f"num_subtasks_at_{name}"),
                 pit.count_upto("created_date", c, F.col("_done")).alias(f"num_completed_at_{name}"),
                 pit.count_upto("created_date", c, F.col("_late")).alias(f"num_overdue_at_{name}"),
                 F.try_divide(F.sum(upto) * F.max("_times"), F.count("_seen")).alias(f"avg_sub_status_changes_at_{name}")]
    return pit.pit_join_agg(st, b, st["task_id"] == b["_tid"], ["_tid"], aggs)


def comment_task_features(r, base: DataFrame) -> DataFrame:
    cm = r.comment.filter(F.col("content_type_id") == CONTENT_TYPE["task"])
    b = base.select(F.col("id").alias("_tid"), "creation_cutoff", "halfway_cutoff")
    return pit.pit_join_agg(cm, b, cm["object_id"] == b["_tid"], ["_tid"],
                            [pit.count_upto("created_date", c).alias(f"task_comment_count_at_{n}")
                             for n, c in CUTS])


def shared_key_pit(events: DataFrame, ev_key: str, ev_ts: str, seq, cut_long: DataFrame,
                   key_col: str, values=(), prefix: str = "") -> DataFrame:
    """pit_merge for (id, checkpoint, cutoff_ts, key) rows, pivoted back to one
    row per task with ``{prefix}n_{checkpoint}`` / ``{prefix}v_{checkpoint}``."""
    m = pit.pit_merge(events, cut_long, ev_key, key_col, ev_ts, "cutoff_ts", seq=seq,
                      values=values, carry=["id", "checkpoint"])
    out = [F.max(F.when(F.col("checkpoint") == n, F.col("pit_n"))).alias(f"{prefix}n_{n}")
           for n, _ in CUTS]
    if values:
        out += [F.max_by(F.col("pit_last"), F.when(F.col("checkpoint") == n, F.lit(1)))
                .alias(f"{prefix}v_{n}") for n, _ in CUTS]
    return m.groupBy(F.col("id").alias("_tid")).agg(*out)


def expanding_rates(r, as_of=AS_OF) -> DataFrame:
    """Department / employee / position self-excluding expanding rates."""
    t = cut.dated(r.task)
    rc = (r.task_history.filter(F.col("history_relation_id").isNotNull())
          .groupBy(F.col("history_relation_id").alias("_rid"))
          .agg(F.count(F.lit(1)).alias("_nrev")))
    pos = r.position.select(F.col("id").alias("_pid"), F.col("department_id").alias("_pdept"),
                            F.col("user_id").alias("_puser"))
    raw = (t.join(pos, t["position_id"] == pos["_pid"], "left")
           .join(rc, t["id"] == rc["_rid"], "left")
           .select("id", "created_date", "position_id",
                   F.coalesce("_pdept", "department_id").alias("dept_id"),
                   F.col("_puser").alias("assignee_id"),
                   lbl.two_tier(as_of=as_of).alias("is_overdue"),
                   F.coalesce("_nrev", F.lit(0)).alias("rev_count")))
    return rates_of_groups(raw)


def rates_of_groups(raw: DataFrame) -> DataFrame:
    """Expanding rates by department (NULL is one), employee and position (NULL is none)
    in one scan over (kind, key), back to one row per task."""
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).cast("bigint").alias("key")) for i, c in enumerate(("dept_id", "assignee_id", "position_id"))])
    long = raw.select("id", "created_date", "is_overdue", "rev_count", F.explode(kinds).alias("g")).select(
        "id", "created_date", "is_overdue", "rev_count", "g.kind", "g.key").where("kind = 0 or key is not null")
    got = expanding_mean(long, ["kind", "key"], "created_date", "id", ["is_overdue", "rev_count"], ["rate", "revisions"], keep=("id", "kind"))
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return got.groupBy("id").agg(of(0, "rate").alias("dept_past_overdue_rate"), of(0, "revisions").alias("dept_avg_revisions"),
                                 of(1, "rate").alias("emp_past_overdue_rate"), of(2, "rate").alias("pos_past_overdue_rate"))


def _enc_asof(snap, field: str, current: str, mapping) -> F.Column:
    v = F.col(snap)[field]
    return F.when(v.isNotNull(), ordinal(v, mapping)).otherwise(ordinal(F.col(current), mapping))


SNAPSHOT = {"status": STATUS_ORDER, "approval_status": APPROVAL_ORDER, "lead_approval_status": APPROVAL_ORDER}


def history_pass(r, base: DataFrame) -> DataFrame:
    """ONE join + partial aggregate over task history for everything the wide
    table needs: first completion (label tier 2), total revisions (group
    rates), revision counts / last revision / status snapshot (as codes) at both cutoffs."""
    th = r.task_history.select(
        "history_relation_id", "history_date", "history_id", (F.col("status") == "completed").alias("_done"),
        *[F.when(F.col(c).isNotNull(), ordinal(c, m)).alias(c) for c, m in SNAPSHOT.items()])  # codes move, not texts
    b = base.select(F.col("id").alias("_tid"), "creation_cutoff", "halfway_cutoff")
    snap = F.struct(*SNAPSHOT)
    aggs = [F.count(F.lit(1)).alias("_rev_total"),
            F.min(F.when(F.col("_done"), F.col("history_date"))).alias("_fc_ts")]
    for name, c in CUTS:
        aggs += [pit.count_upto("history_date", c).alias(f"num_revisions_at_{name}"),
                 pit.max_upto("history_date", c).alias(f"last_revision_at_{name}"),
                 pit.latest_upto(snap, "history_date", ["history_id"], c).alias(f"_snap_{name}")]
    return pit.pit_join_agg(th, b, th["history_relation_id"] == b["_tid"], ["_tid"], aggs)


def parent_pass(r, base: DataFrame) -> DataFrame:
    """Parent (MA) revisions, grand-parent (KPI) revisions + latest state, and
    parent comments — three shared-key event sources scanned by ONE union-scan
    keyed by (source, id), then pivoted back to one row per task.  Parent revisions and
    comments share a key, so a task has one cutoff row for both.  Only KPI events, whose
    latest state is wanted, carry a tie-breaker; the state goes as its two codes, so that
    the pivot is a hash aggregate."""
    vtype, stype = "struct<is_overdue:int,status:int>", "struct<s1:bigint,s2:bigint>"
    src = {"ma": 0, "kpi": 1}

    def counted(df, key, ts, kind):
        return df.select(F.lit(src["ma"]).cast("tinyint").alias("_src"), F.col(key).cast("bigint").alias("_k"), F.col(ts).alias("_ts"),
                         F.lit(None).cast(stype).alias("_seq"), F.lit(None).cast(vtype).alias("_v"), F.lit(kind).alias("_kind"))
    ev = (counted(r.major_activity_history, "id", "history_date", 0)
          .unionByName(counted(r.comment.filter(F.col("content_type_id") == CONTENT_TYPE["major_activity"]), "object_id", "created_date", 1))
          .unionByName(r.kpi_history.select(
              F.lit(src["kpi"]).cast("tinyint").alias("_src"), F.col("id").cast("bigint").alias("_k"), F.col("history_date").alias("_ts"),
              F.struct(F.col("history_id").cast("bigint").alias("s1"), F.col("history_seq").cast("bigint").alias("s2")).alias("_seq"),
              F.struct(F.col("is_overdue").cast("int").alias("is_overdue"),
                       F.when(F.col("status").isNotNull(), ordinal("status", KPI_STATUS_ORDER)).alias("status")).cast(vtype).alias("_v"),
              F.lit(0).alias("_kind"))))
    # a task's cutoffs by number: 0 creation, 1 halfway
    cu = (base.select("id", "major_activity_id", "kpi_id", F.posexplode(F.array(*[F.col(c) for _, c in CUTS])).alias("_at", "_ts"))
          .select("id", F.col("_at").cast("tinyint").alias("_at"), "_ts", F.explode(F.array(
              F.struct(F.lit(src["ma"]).cast("tinyint").alias("s"), F.col("major_activity_id").cast("bigint").alias("k")),
              F.struct(F.lit(src["kpi"]).cast("tinyint").alias("s"), F.col("kpi_id").cast("bigint").alias("k")))).alias("_sk"))
          .select("id", "_at", "_ts", F.col("_sk.s").alias("_src"), F.col("_sk.k").alias("_k")))
    m = pit.pit_merge_frames(ev, cu, ["id", "_at", "_src"], last_ts=False, keys=("_src", "_k"))
    out = []
    for at, (n, _) in enumerate(CUTS):
        of = {name: (F.col("_src") == code) & (F.col("_at") == at) for name, code in src.items()}
        out += [F.max(F.when(of[name], F.col("pit_n"))).alias(f"{name}_n_{n}") for name in src]
        out += [F.max(F.when(of["kpi"], F.col("pit_last")[f])).alias(f"kpi_{f}_{n}") for f in ("is_overdue", "status")]
        if n == "creation":
            out.append(F.max(F.when(of["ma"], F.col("pit_n1"))).alias("cmk_n_creation"))
    return m.groupBy(F.col("id").alias("_tid")).agg(*out)


def leak_free_wide(r, as_of=AS_OF, impute: bool = True, store=None) -> DataFrame:
    """Dual-cutoff feature table (one row per dated task).  ``store`` (a function of
    a frame and a name) writes the labelled base once, best in buckets of the task id
    (``stored_by_id``): seven branches read it, and join by that id.  The branches are stored
    so one after another: each one's shuffle files and range partitions go before the next begins."""
    base = cut.base_tasks(r.task, as_of)
    hp = history_pass(r, base)
    ma = r.major_activity.select(F.col("id").alias("_maid"), ordinal("status", MA_STATUS_ORDER).alias("_ma_status"),
                                 ordinal("approval_status", APPROVAL_ORDER).alias("_ma_approval_status"), "kpi_id", F.lit(True).alias("_ma"))
    pos = r.position.select(F.col("id").alias("_posid"), F.col("department_id").alias("_posdept"),
                            F.col("user_id").alias("_puser"))
    cda = r.cross_dept_assignment.select(F.col("id").alias("_cdaid"))
    label, source = lbl.three_tier(as_of=as_of)
    # what the branches and the final join need, texts as their codes (a task without parent has the code of NULL)
    none = lambda m: ordinal(F.lit(None).cast("string"), m)
    kept = ["id", "created_date", "creation_cutoff", "halfway_cutoff", "major_activity_id", "kpi_id", "position_id", "planned_duration",
            "creation_to_planned_start", "created_dow", "created_is_weekend", "created_is_friday", "created_month", "created_quarter",
            "is_planned", "risk_mapping", "is_cross_dept", "days_since_update_halfway", "_puser"]
    known = (base.join(ma, base["major_activity_id"] == ma["_maid"], "left")
             .join(pos, base["position_id"] == pos["_posid"], "left")
             .join(cda, base["derived_from_cross_department_assignment_id"] == cda["_cdaid"], "left")
             .select(*kept, F.col("_cdaid").isNotNull().cast("int").alias("cross_dept_pair_exists"),
                     F.coalesce("_posdept", "department_id").alias("resolved_dept_id"), lbl.two_tier(as_of=as_of).alias("_two_tier"),
                     F.when(F.col("_ma"), F.col("_ma_status")).otherwise(none(MA_STATUS_ORDER)).alias("_ma_status"),
                     F.when(F.col("_ma"), F.col("_ma_approval_status")).otherwise(none(APPROVAL_ORDER)).alias("_ma_approval_status"),
                     *[ordinal(c, m).alias(f"_{c}") for c, m in SNAPSHOT.items()], "status", "end_date", "actual_end_date", "updated_date"))
    # the history comes last, so that the rows lie by task id, as they are stored
    now = [F.coalesce(F.col(f"_snap_{n}")[c], F.col(f"_{c}")).alias(f"{c}_encoded_at_{n}") for n, _ in CUTS for c in SNAPSHOT]
    b = (known.join(hp, F.col("id") == F.col("_tid"), "left").withColumn("first_completed_at", F.to_date("_fc_ts"))
         .select(*kept, "cross_dept_pair_exists", "resolved_dept_id", "_rev_total", "_two_tier", "_ma_status", "_ma_approval_status",
                 label.alias("calculated_overdue"), source.alias("target_source"), *now,
                 *[f"{c}_at_{n}" for n, _ in CUTS for c in ("num_revisions", "last_revision")]))

    if store is not None:
        b = base = store(b, "labelled-base")
        free_shuffles(b.sparkSession)

    def branch(f: DataFrame, name: str, key: str = "_tid") -> DataFrame:
        return f if store is None else stored_step(store, f, name, key, base)

    # expanding group rates over the same rows
    raw = b.select("id", "created_date", "position_id", F.col("resolved_dept_id").alias("dept_id"), F.col("_puser").alias("assignee_id"),
                   F.col("_two_tier").alias("is_overdue"), F.coalesce("_rev_total", F.lit(0)).alias("rev_count"))
    par = branch(parent_pass(r, b), "parents")
    rates = branch(rates_of_groups(raw), "rates", "id")
    stf = branch(subtask_pass(r, base, branch), "subtasks")
    ctf = branch(comment_task_features(r, base), "comments")

    w = b
    for f in (stf, ctf, par):
        w = w.join(f, w["id"] == f["_tid"], "left").drop("_tid")
    w = w.join(rates, "id", "left")

    cols = [
        "id", "calculated_overdue", "target_source",
        "planned_duration", "creation_to_planned_start", "created_dow", "created_is_weekend",
        "created_is_friday", "created_month", "created_quarter", "is_planned", "risk_mapping",
        "is_cross_dept", "cross_dept_pair_exists", "days_since_update_halfway",
        "dept_past_overdue_rate", "dept_avg_revisions", "emp_past_overdue_rate",
        "pos_past_overdue_rate", "resolved_dept_id",
    ]
    for n, _ in CUTS:
        nrev = F.coalesce(F.col(f"num_revisions_at_{n}"), F.lit(0))
        nsub = F.coalesce(F.col(f"num_subtasks_at_{n}"), F.lit(0))
        cols += [
            *[f"{c}_encoded_at_{n}" for c in SNAPSHOT],
            F.col("_ma_status").alias(f"ma_status_encoded_at_{n}"),
            F.col("_ma_approval_status").alias(f"ma_approval_status_encoded_at_{n}"),
            F.coalesce(F.col(f"ma_n_{n}"), F.lit(0)).cast("int").alias(f"num_ma_revisions_at_{n}"),
            F.coalesce(F.col(f"kpi_is_overdue_{n}"), F.lit(0)).alias(f"kpi_is_overdue_flag_at_{n}"),
            F.coalesce(F.col(f"kpi_status_{n}"), F.lit(1)).cast("int").alias(f"kpi_status_ordinal_at_{n}"),
            F.coalesce(F.col(f"kpi_n_{n}"), F.lit(0)).cast("int").alias(f"num_kpi_revisions_at_{n}"),
        ]
        if n == "creation":
            cols.append(F.coalesce(F.col("cmk_n_creation"), F.lit(0)).cast("int")
                        .alias("kpi_comment_count_at_creation"))
        cols += [
            nrev.cast("int").alias(f"num_revisions_at_{n}"),
            F.when(F.col("planned_duration") > 0, safe_ratio(nrev, "planned_duration"))
            .otherwise(0.0).alias(f"revision_frequency_at_{n}"),
            F.when(F.col(f"last_revision_at_{n}").isNotNull(),
                   F.datediff(lit_date(as_of), F.to_date(F.col(f"last_revision_at_{n}"))))
            .otherwise(0).cast("int").alias(f"revision_recency_at_{n}"),
            nsub.cast("int").alias(f"num_subtasks_at_{n}"),
            (nsub > 0).cast("int").alias(f"has_subtasks_at_{n}"),
            F.when(nsub > 0, safe_ratio(f"num_completed_at_{n}", nsub)).otherwise(0.0)
            .alias(f"subtask_completion_pct_at_{n}"),
            F.when(nsub > 0, safe_ratio(f"num_overdue_at_{n}", nsub)).otherwise(0.0)
            .alias(f"subtask_overdue_rate_at_{n}"),
            F.coalesce(F.col(f"task_comment_count_at_{n}"), F.lit(0)).cast("int")
            .alias(f"task_comment_count_at_{n}"),
            F.coalesce(F.col(f"avg_sub_status_changes_at_{n}"), F.lit(0.0))
            .alias(f"avg_sub_status_changes_at_{n}"),
        ]
    out = w.select(*cols)
    return impute_rates(out, b) if impute else out


def impute_rates(df: DataFrame, label_src: DataFrame | None = None) -> DataFrame:
    """Fill missing expanding rates: label rates with the global label mean (a
    1-row aggregate, broadcast — its size is fixed), revisions with 0.
    ``label_src`` (same rows, fewer joins) avoids re-running the wide plan for
    the mean."""
    gm = (label_src if label_src is not None else df).agg(F.avg("calculated_overdue").alias("_gm"))
    return (df.crossJoin(F.broadcast(gm))
            .withColumn("dept_past_overdue_rate", F.coalesce("dept_past_overdue_rate", "_gm"))
            .withColumn("emp_past_overdue_rate", F.coalesce("emp_past_overdue_rate", "_gm"))
            .withColumn("pos_past_overdue_rate", F.coalesce("pos_past_overdue_rate", "_gm"))
            .withColumn("dept_avg_revisions", F.coalesce("dept_avg_revisions", F.lit(0.0)))
            .drop("_gm"))


def checkpoint_dataset(wide: DataFrame, checkpoint: str) -> DataFrame:
    """Project the dual table to one checkpoint's training dataset (clean names)."""
    cols = [F.col(c) for c in STATIC_COLS]
    cols += [F.col(f"{f}_at_{checkpoint}").alias(f) for f in DUAL_FEATURES]
    if checkpoint == "halfway":
        cols += [F.col(src).alias(dst) for dst, src in HALFWAY_EXTRA]
    return zero_filled(wide.select(*cols))


def zero_filled(df: DataFrame, keep=("id", "target_source")) -> DataFrame:
    """Every column but ``keep`` as a number, NULL (also of text that is no number) as 0."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name in keep:
            out.append(c)
        elif f.dataType.typeName() == "string":
            out.append(F.coalesce(F.expr(f"try_cast(`{f.name}` AS double)"), F.lit(0.0)).alias(f.name))
        else:
            out.append(F.coalesce(c, F.lit(0).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def checkpoint_long(wide: DataFrame) -> DataFrame:
    """Both checkpoints stacked with a ``checkpoint`` column (partition key for sinks)."""
    c = checkpoint_dataset(wide, "creation")
    h = checkpoint_dataset(wide, "halfway")
    for dst, _ in HALFWAY_EXTRA:
        c = c.withColumn(dst, F.lit(None).cast(h.schema[dst].dataType))
    return (c.withColumn("checkpoint", F.lit("creation"))
            .unionByName(h.withColumn("checkpoint", F.lit("halfway"))))


_MEMO: dict = {}


def stored_step(store, df: DataFrame, name: str, key: str, *but: DataFrame) -> DataFrame:
    """``df`` stored under its key as ``id``; what its making left on disk goes, but the tables of ``but``."""
    out = store(df.withColumnRenamed(key, "id"), name)
    forget(df, *but)
    free_shuffles(df.sparkSession)
    return out.withColumnRenamed("id", key)


def stored_by_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored in one bucket of ``id`` per shuffle partition: joins and groups by it move
    the other side only."""
    n = shuffle_partitions(df)
    return stored_buckets(df.repartition(n, "id"), name, "id", n)


def feature_table(spark, sf_dir: str, as_of=AS_OF) -> DataFrame:
    """The leak-free wide table, built once per application and input folder and
    written as Parquet into the cluster's shared ``spark.checkpoint.dir``
    (survives executor loss; downstream analytics read the columns they need
    instead of re-running the PIT plan)."""
    from ..session import state_of, stored_table
    from ..sources.roles import roles
    key = (spark.sparkContext.applicationId, sf_dir, state_of(spark, sf_dir), str(as_of))
    if key not in _MEMO:
        wide = leak_free_wide(roles(spark, sf_dir), as_of, store=stored_by_id)
        _MEMO[key] = stored_table(wide, "features")
        forget(wide)
        free_shuffles(spark)
    return _MEMO[key]


def current_wide(r, as_of=AS_OF, store=None) -> DataFrame:
    """As-of-now ("leaky") feature table: every aggregate uncut, group rates over
    the whole history, imputed and encoded.  Kept for comparison with the
    leak-free table; each input is pre-aggregated on its key before joining.  ``store`` (a
    function of a frame and a name, best ``stored_by_id``) writes the joined rows once: the means
    and the encoding read them too; and before, one after another, what is joined by the task id,
    so that only one step's shuffle files are there at a time."""
    from .q_analytics import _challenge_flags
    c = F.col

    def step(f: DataFrame, name: str, key: str, *but: DataFrame) -> DataFrame:
        return f if store is None else stored_step(store, f, name, key, *but)
    base = cut.base_tasks(r.task, as_of)
    th = r.task_history.filter(c("history_relation_id").isNotNull())
    rev = th.groupBy(c("history_relation_id").alias("_rid")).agg(
        F.count(F.lit(1)).alias("_nrev"), F.max("history_date").alias("_last"),
        F.min(F.when(c("status") == "completed", c("history_date"))).alias("_fc"))
    rev = step(rev, "revisions", "_rid")
    sub = (r.sub_task.filter(c("task_id").isNotNull()).groupBy(c("task_id").alias("_sid_t"))
           .agg(F.count(F.lit(1)).alias("_ns"), F.count_if(c("status") == "completed").alias("_nc"),
                F.count_if(c("is_overdue")).alias("_no")))
    sub = step(sub, "subtasks", "_sid_t")
    # halfway completion, leaky mode: uncapped midpoint, history falling back to current
    tmid = (r.task.filter(c("start_date").isNotNull() & c("end_date").isNotNull() & (c("start_date") <= c("end_date")))
            .select("id", cut.as_ts(cut.midpoint_date("start_date", "end_date")).alias("halfway_date")))
    st = r.sub_task.select(c("id").alias("_sid"), c("task_id").alias("_stid"), c("created_date").alias("_sc"),
                           c("status").alias("_scur"))
    subs = st.join(tmid.select(c("id").alias("_hid"), c("halfway_date").alias("_cut")), c("_stid") == c("_hid"))
    sth = r.sub_task_history
    lh = (sth.join(subs.select(c("_sid").alias("_lsid"), c("_cut").alias("_lcut")), sth["id"] == c("_lsid"))
          .groupBy("_lsid").agg(pit.latest_upto(F.struct("status"), "history_date", ["history_id"], "_lcut").alias("_lh")))
    hs = (subs.join(lh, c("_sid") == c("_lsid"), "left").filter(c("_sc") <= c("_cut"))
          .groupBy(c("_stid").alias("_hs_t")).agg(
              F.count(F.lit(1)).alias("_hn"),
              F.count_if(F.coalesce(c("_lh")["status"], c("_scur")) == "completed").alias("_hc")))
    hs = step(hs, "subtasks-halfway", "_hs_t")
    pos = r.position.select(c("id").alias("_pid"), c("department_id").alias("_pdept"), c("user_id").alias("_puser"))
    t2 = (r.task.join(pos, c("position_id") == c("_pid"), "left").join(rev, c("id") == c("_rid"), "left")
          .select("id", "position_id", "_puser", "_nrev", F.coalesce("_pdept", "department_id").alias("_tdept"), lbl.two_tier(as_of=as_of).alias("_y")))
    t2 = step(t2, "group-rows", "id", rev)  # three groupings read it
    dept = t2.groupBy(c("_tdept").alias("_did")).agg(
        F.count(F.lit(1)).alias("dept_task_count"), F.avg("_y").alias("dept_past_overdue_rate"),
        F.avg(F.coalesce("_nrev", F.lit(0))).alias("dept_avg_revisions"))
    emp = t2.filter(c("_puser").isNotNull()).groupBy(c("_puser").alias("_eid")).agg(
        F.avg("_y").alias("emp_past_overdue_rate"))
    posr = t2.filter(c("position_id").isNotNull()).groupBy(c("position_id").alias("_prid")).agg(
        F.avg("_y").alias("pos_past_overdue_rate"))
    ma = r.major_activity.select(c("id").alias("_maid"), c("status").alias("ma_status"),
                                 c("approval_status").alias("ma_approval_status"), "kpi_id")
    mar = r.major_activity_history.filter(c("id").isNotNull()).groupBy(c("id").alias("_mrid")).agg(
        F.count(F.lit(1)).alias("_nmr"))
    kp = r.kpi.select(c("id").alias("_kid"), c("is_overdue").cast("int").alias("_kov"),
                      ordinal("status", KPI_STATUS_ORDER).alias("_kord"))
    kh = r.kpi_history.filter(c("id").isNotNull()).groupBy(c("id").alias("_khid")).agg(F.count(F.lit(1)).alias("_nkr"))
    cm = r.comment.groupBy("content_type_id", "object_id").agg(F.count(F.lit(1)).alias("_n"))

    def cm_of(t, name):
        return cm.filter(c("content_type_id") == t).select(c("object_id").alias(f"_o{name}"), c("_n").alias(f"_c{name}"))
    first = r.sub_task_history.filter(c("id").isNotNull()).groupBy(c("id").alias("_chs")).agg(
        F.count_distinct("status").alias("_nd"))
    churn = (first.join(r.sub_task.select(c("id").alias("_chs2"), c("task_id").alias("_cht")), c("_chs") == c("_chs2"))
             .groupBy("_cht").agg(F.avg("_nd").alias("avg_sub_status_changes")))
    churn = step(churn, "churn", "_cht")
    cda = r.cross_dept_assignment.select(c("id").alias("_cdaid"))
    chal = step(_challenge_flags(r), "challenges", "_cid")
    ct = step(cm_of(CONTENT_TYPE["task"], "t"), "comments", "_ot")

    # joins of one key stand together, those by task id last: the wide rows move once a key, texts as their codes
    codes = {"approval_status_encoded": ordinal("approval_status", APPROVAL_ORDER), "lead_approval_status_encoded": ordinal("lead_approval_status", APPROVAL_ORDER)}
    kept = ["id", "planned_duration", "creation_to_planned_start", "days_since_update_halfway", "created_dow", "created_is_weekend",
            "created_is_friday", "created_month", "created_quarter", "is_planned", "risk_mapping", "is_cross_dept", "position_id", "weight_level",
            "status", "created_date", "end_date", "actual_end_date", "updated_date", *codes]
    joined = ["ma_status_encoded", "ma_approval_status_encoded", "dept_past_overdue_rate", "dept_avg_revisions", "dept_task_count",
              "emp_past_overdue_rate", "pos_past_overdue_rate", "_cdaid", "_nmr", "_kov", "_kord", "_nkr", "_ck", "_cm", "resolved_dept_id"]
    b = (base.withColumns(codes).join(pos, c("position_id") == c("_pid"), "left").join(posr, c("position_id") == c("_prid"), "left")
         .withColumn("resolved_dept_id", F.coalesce("_pdept", "department_id"))
         .join(ma, c("major_activity_id") == c("_maid"), "left").join(mar, c("major_activity_id") == c("_mrid"), "left")
         .join(cm_of(CONTENT_TYPE["major_activity"], "m"), c("major_activity_id") == c("_om"), "left")
         .join(dept, c("resolved_dept_id") == c("_did"), "left").join(emp, c("_puser") == c("_eid"), "left")
         .join(cda, c("derived_from_cross_department_assignment_id") == c("_cdaid"), "left")
         .join(kp, c("kpi_id") == c("_kid"), "left").join(kh, c("kpi_id") == c("_khid"), "left")
         .join(cm_of(CONTENT_TYPE["kpi"], "k"), c("kpi_id") == c("_ok"), "left"))
    b = step(b.withColumns({"ma_status_encoded": ordinal("ma_status", MA_STATUS_ORDER), "ma_approval_status_encoded": ordinal("ma_approval_status", APPROVAL_ORDER)})
             .select(*kept, *joined), "current-base", "id", rev)
    b = (b.join(rev, c("id") == c("_rid"), "left").withColumn("first_completed_at", F.to_date("_fc"))
         .join(sub, c("id") == c("_sid_t"), "left").join(hs, c("id") == c("_hs_t"), "left")
         .join(chal, c("id") == c("_cid"), "left")
         .join(ct, c("id") == c("_ot"), "left")
         .join(churn, c("id") == c("_cht"), "left"))
    label, source = lbl.three_tier(as_of=as_of)
    days_c = F.datediff(lit_date(as_of), F.to_date("created_date"))
    out = b.select(
        "id", label.alias("calculated_overdue"), source.alias("target_source"),
        "planned_duration", "creation_to_planned_start", c("days_since_update_halfway").alias("days_since_update"),
        "created_dow", "created_is_weekend", "created_is_friday", "created_month", "created_quarter",
        "is_planned", "risk_mapping", "is_cross_dept", "position_id", "weight_level",
        ordinal("status", STATUS_ORDER).alias("status_encoded"),
        "approval_status_encoded", "lead_approval_status_encoded", "ma_status_encoded", "ma_approval_status_encoded",
        F.coalesce("_nrev", F.lit(0)).cast("int").alias("num_revisions"),
        F.try_divide(c("_nrev").cast("double"), F.when(days_c != 0, days_c)).alias("revision_frequency"),
        F.datediff(lit_date(as_of), F.to_date("_last")).alias("revision_recency"),
        F.coalesce("_ns", F.lit(0)).cast("int").alias("num_subtasks"),
        (F.coalesce("_ns", F.lit(0)) > 0).cast("int").alias("has_subtasks"),
        F.try_divide(c("_nc").cast("double"), c("_ns")).alias("subtask_completion_pct"),
        F.try_divide(c("_no").cast("double"), c("_ns")).alias("subtask_overdue_rate"),
        F.try_divide(c("_hc").cast("double"), c("_hn")).alias("subtask_completion_pct_at_halfway"),
        c("num_challenges").cast("int").alias("num_challenges"), "has_challenges",
        c("has_subtask_challenge"), c("num_subtask_challenges").cast("int").alias("num_subtask_challenges"),
        c("num_kpi_challenges").cast("int").alias("num_kpi_challenges"), "has_kpi_challenge",
        c("num_kpi_potential_challenges").cast("int").alias("num_kpi_potential_challenges"),
        "has_kpi_potential_challenge",
        "dept_past_overdue_rate", "dept_avg_revisions", "dept_task_count", "emp_past_overdue_rate",
        "pos_past_overdue_rate", c("_cdaid").isNotNull().cast("int").alias("cross_dept_pair_exists"),
        F.coalesce("_nmr", F.lit(0)).cast("int").alias("num_ma_revisions"),
        F.coalesce("_kov", F.lit(0)).cast("int").alias("kpi_is_overdue_flag"),
        F.coalesce("_kord", F.lit(1)).cast("int").alias("kpi_status_ordinal"),
        F.coalesce("_nkr", F.lit(0)).cast("int").alias("num_kpi_revisions"),
        F.coalesce("_ck", F.lit(0)).cast("int").alias("kpi_comment_count"),
        F.coalesce("_cm", F.lit(0)).cast("int").alias("ma_comment_count"),
        F.coalesce("_ct", F.lit(0)).cast("int").alias("task_comment_count"),
        "avg_sub_status_changes", "resolved_dept_id")
    if store is not None:
        rows = out
        out = store(rows, "current-rows")
        forget(rows)
        free_shuffles(rows.sparkSession)
    from ..functions import encode as enc
    zero = ["is_cross_dept", "revision_frequency", "revision_recency", "subtask_completion_pct",
            "subtask_overdue_rate", "subtask_completion_pct_at_halfway", "num_challenges", "has_challenges",
            "cross_dept_pair_exists", "kpi_is_overdue_flag", "has_subtask_challenge", "num_subtask_challenges",
            "has_kpi_challenge", "num_kpi_challenges", "has_kpi_potential_challenge",
            "num_kpi_potential_challenges", "kpi_comment_count", "ma_comment_count", "task_comment_count",
            "avg_sub_status_changes"]
    out = enc.fill_zero(out, zero)
    out = enc.fill_mean(out, ["dept_past_overdue_rate", "dept_avg_revisions", "emp_past_overdue_rate",
                              "pos_past_overdue_rate"])
    out = enc.one_hot(out, "weight_level", ["high", "mid", "low"], "wl")
    out = enc.target_encode(out, "position_id", "calculated_overdue", "position_id_encoded")
    return out.drop("weight_level")
