"""Scalar helpers: safe ratios, clipping, ordinal maps, right-closed bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


INF = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(num, den, default: float = 0.0) -> Column:
    """num / den, ``default`` when den is 0 or NULL (ANSI-safe)."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den).cast("double")),
                      F.lit(float(default)))


def clipped_ratio(num, den, lo: float = 0.0, hi: float = 2.0) -> Column:
    """num/den clipped to [lo, hi]; NULL when den <= 0 or NULL."""
    r = _c(num).cast("double") / _c(den).cast("double")
    return F.when(_c(den) > 0, F.least(F.greatest(r, F.lit(lo)), F.lit(hi)))


def clip(x, lower=None, upper=None) -> Column:
    c = _c(x)
    if lower is not None:
        c = F.when(c.isNull(), c).otherwise(F.greatest(c, F.lit(lower)))
    if upper is not None:
        c = F.when(c.isNull(), c).otherwise(F.least(c, F.lit(upper)))
    return c


def ordinal(x, mapping: Mapping[str, int], fallback: int | None = 1) -> Column:
    """Map a string column through ``mapping``; unknown/NULL -> ``fallback``."""
    c = _c(x)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v)))
    if fallback is not None:
        expr = expr.otherwise(F.lit(fallback))
    return expr.cast("int")


def right_closed_bin(x, edges: Sequence[float], labels: Sequence[str],
                     include_lowest: bool = False) -> Column:
    """pandas ``cut`` semantics: (e[i], e[i+1]] -> labels[i]; NULL outside.  An
    infinite outer edge leaves that end open."""
    return _cut(x, edges, labels, include_lowest)


def bin_index(x, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """0-based right-closed bin index (NULL outside) — doubles as a sort key."""
    return _cut(x, edges, range(len(edges) - 1), include_lowest)


def _cut(x, edges: Sequence[float], values: Sequence, include_lowest: bool) -> Column:
    c = _c(x)
    expr = None
    for i, v in enumerate(values):
        lo, hi = edges[i], edges[i + 1]
        cond = c.isNotNull()
        if lo != -INF:
            cond = cond & ((c >= lo) if include_lowest and i == 0 else (c > lo))
        if hi != INF:
            cond = cond & (c <= hi)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr


def bin_case_sql(col: str, edges: Sequence[float], labels: Sequence[str], index: bool = False) -> str:
    """SQL text of ``right_closed_bin`` (or ``bin_index``)."""
    parts = []
    for i, lab in enumerate(labels):
        cond = [f"{col} IS NOT NULL"]
        cond += [f"{col} > {edges[i]}"] if edges[i] != -INF else []
        cond += [f"{col} <= {edges[i + 1]}"] if edges[i + 1] != INF else []
        parts.append(f"WHEN {' AND '.join(cond)} THEN " + (str(i) if index else f"'{lab}'"))
    return "CASE " + " ".join(parts) + " END"


def sql_round(x, digits: int = 0) -> Column:
    """Round a double the way SQL engines do on binary doubles: scale by
    10^digits, round half away from zero, unscale.  (Spark's ``round`` on a
    double rounds its shortest decimal text, which differs on values such as
    4.0434375 whose binary product with 10^6 lies just below the tie.)"""
    m = float(10 ** digits)
    c = _c(x).cast("double")
    return F.round(c * F.lit(m), 0) / F.lit(m) if digits else F.round(c, 0)


def r6(x, digits: int = 6) -> Column:
    return sql_round(x, digits)
