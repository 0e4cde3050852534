"""Point-in-time (as-of) operators.

Two physical shapes, chosen by the cardinality of the join key:

``pit_join_agg``
    Entities carry their own cutoffs and the key is unique per entity (task id,
    subtask id).  Events are equi-joined to their entity and aggregated with
    cutoff-filtered aggregates.  Fan-out is 1:N, the aggregate is partial
    (map-side) and AQE's skew-join splits a hot key's event partitions.

``pit_merge``
    Many cutoff rows share a key (all tasks of one KPI).  An equi join would
    emit events x cutoffs pairs — quadratic on a hot key.  Instead events and
    cutoffs are unioned and scanned once in time order by ``ranges.scan``, events
    sorting before cutoffs at equal timestamps because the predicate is ``ts <=
    cutoff``; no task holds a whole key or a whole day of one.  Output: one row per
    cutoff row with the event count, last event timestamp and latest value(s) as of
    the cutoff.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import scan


def pit_join_agg(events: DataFrame, entities: DataFrame, on: Column | list,
                 group_cols: Sequence[str], aggs: Sequence[Column],
                 how: str = "inner") -> DataFrame:
    """Equi join of events to entities (unique key) + cutoff-filtered aggregates."""
    return events.join(entities, on, how).groupBy(*group_cols).agg(*aggs)


def count_upto(ts: str | Column, cutoff: str | Column, cond: Column | None = None) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    cutoff = F.col(cutoff) if isinstance(cutoff, str) else cutoff
    c = ts <= cutoff
    if cond is not None:
        c = c & cond
    return F.count_if(c)


def max_upto(ts: str | Column, cutoff: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    cutoff = F.col(cutoff) if isinstance(cutoff, str) else cutoff
    return F.max(F.when(ts <= cutoff, ts))


def latest_upto(value: Column, ts: str, seq: Sequence[str], cutoff: str | Column) -> Column:
    """Latest ``value`` with ts <= cutoff, ties broken by ``seq`` (max_by skips
    rows whose ordering is NULL, i.e. rows after the cutoff)."""
    cutoff = F.col(cutoff) if isinstance(cutoff, str) else cutoff
    order = F.struct(F.col(ts), *[F.col(s) for s in seq])
    return F.max_by(value, F.when(F.col(ts) <= cutoff, order))


def pit_merge(events: DataFrame, cutoffs: DataFrame, event_key: str, cutoff_key: str,
              event_ts: str, cutoff_ts: str, seq: Sequence[str] = (),
              values: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """As-of scan of shared-key events for many cutoffs (see module doc).

    Returns ``carry`` columns of ``cutoffs`` plus ``pit_n`` (events with
    ts <= cutoff), ``pit_last_ts`` and ``pit_last`` (struct of ``values`` of the
    latest such event, NULL when none).
    """
    vals = F.struct(*[F.col(v) for v in values]) if values else F.lit(None)
    seqs = [F.col(s) for s in seq] or [F.lit(0)]
    ev = events.select(F.col(event_key).alias("_k"), F.col(event_ts).alias("_ts"),
                       F.struct(*seqs).alias("_seq"), vals.alias("_v"))
    cu = cutoffs.select(F.col(cutoff_key).alias("_k"), F.col(cutoff_ts).alias("_ts"), *carry)
    return pit_merge_frames(ev, cu, carry)


def pit_merge_frames(ev: DataFrame, cu: DataFrame, carry: Sequence[str], last_ts: bool = True,
                     keys: Sequence[str] = ("_k",)) -> DataFrame:
    """``pit_merge`` on canonical frames: ``ev(_k, _ts, _seq, _v)`` and
    ``cu(_k, _ts, *carry)``.  ``_k`` may be a struct (several event sources
    scanned in one pass: key = (source, id)).  ``last_ts=False`` skips the
    last-event-timestamp output (one window function less).  ``keys`` names
    the key columns when the key is composite (flat columns hash and sort
    faster than a struct); ``carry`` may name some of them.  With a ``_kind`` (0 or 1)
    in ``ev`` two sorts of events share a key: ``pit_n`` counts the first, ``pit_n1`` the other."""
    keys = list(keys)
    key_ok = F.lit(True)
    for k in keys:
        key_ok = key_ok & F.col(k).isNotNull()
    two = "_kind" in ev.columns
    own = [c for c in carry if c not in keys]
    ev = (ev.filter(key_ok & F.col("_ts").isNotNull())
          .select(*keys, F.col("_ts").cast("timestamp_ntz").alias("_ts"), "_seq", "_v",
                  (F.col("_kind") if two else F.lit(0)).cast("tinyint").alias("_what"),
                  *[F.lit(None).cast(cu.schema[c].dataType).alias(c) for c in own]))
    unkeyed = cu.filter(~key_ok).select(*carry)  # a cutoff without a key has no events
    cu = cu.filter(key_ok).select(*keys, F.col("_ts").cast("timestamp_ntz").alias("_ts"),
                   F.lit(None).cast(ev.schema["_seq"].dataType).alias("_seq"),
                   F.lit(None).cast(ev.schema["_v"].dataType).alias("_v"), F.lit(2).cast("tinyint").alias("_what"), *own)
    u = ev.unionByName(cu)
    is_ev = F.col("_what") < 2

    counts = {"_n": 0, "_n1": 1} if two else {"_n": 0}
    running = {n: ("sum", F.when(F.col("_what") == kind, 1).otherwise(0).cast("bigint")) for n, kind in counts.items()}
    running["_lv"] = ("last", F.when(is_ev, F.struct("_v")))
    if last_ts:
        running["_mx"] = ("max", F.when(is_ev, F.col("_ts")))
    got = scan(u, keys, ["_ts", "_what", "_seq"], running, name="pit").filter(~is_ev)
    last = F.col("_mx") if last_ts else F.lit(None).cast("timestamp_ntz")
    out = got.select(*carry, *[F.col(n).cast("bigint").alias(f"pit{n}") for n in counts], last.alias("pit_last_ts"), F.col("_lv")["_v"].alias("pit_last"))
    kinds = {f.name: f.dataType for f in out.schema.fields}
    return out.unionByName(unkeyed.select(
        *carry, *[F.lit(0).cast("bigint").alias(f"pit{n}") for n in counts], F.lit(None).cast(kinds["pit_last_ts"]).alias("pit_last_ts"),
        F.lit(None).cast(kinds["pit_last"]).alias("pit_last")))


def churn_first_seen(history: DataFrame, key: str, ts: str, value: str,
                     seq: Sequence[str] = ()) -> DataFrame:
    """First occurrence of each (key, value): a partial aggregate, so COUNT
    DISTINCT value as-of a cutoff becomes a PIT count over first-seen events.
    A NULL value keeps its key but has no first time: it counts for nothing; so does
    a value with a NULL time, which sorts first.  (Ties by ``seq`` do not move the time.)"""
    known = F.count(ts) == F.count(F.lit(1))
    return (history.filter(F.col(key).isNotNull())
            .groupBy(key, value).agg(F.when(known, F.min(ts)).alias("_first"))
            .select(key, value, F.when(F.col(value).isNotNull(), F.col("_first")).alias(ts)))
