"""Date/time expressions with the reference's conventions.

* whole-day differences between timestamps floor (pandas ``.dt.days``), they
  do not truncate toward zero (``timestampdiff(DAY)`` would);
* weekday is Monday = 0;
* the halfway midpoint adds ``(end - start) DIV 2`` whole days (truncating).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_US = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_date(d: _dt.date | str) -> Column:
    return F.lit(d if isinstance(d, _dt.date) else _dt.date.fromisoformat(d))


def as_ts(x) -> Column:
    """Date or timestamp -> timestamp_ntz (midnight for dates)."""
    return _c(x).cast("timestamp_ntz")


def floor_days(end, start) -> Column:
    """floor((end - start) / 1 day) for dates or timestamps, as BIGINT.

    Computed from calendar fields only (whole days between the dates, minus
    one when end's time of day is earlier than start's), so the result never
    depends on the session time zone or DST."""
    e, s = as_ts(end), as_ts(start)
    tod_e = e - F.to_date(e).cast("timestamp_ntz")
    tod_s = s - F.to_date(s).cast("timestamp_ntz")
    return (F.datediff(F.to_date(e), F.to_date(s))
            - F.when(tod_e < tod_s, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def date_days(end, start) -> Column:
    """Whole days between two dates (``end - start``), BIGINT."""
    return F.datediff(_c(end), _c(start)).cast("bigint")


def weekday_mon0(x) -> Column:
    return F.weekday(_c(x))


def midpoint_date(start, end) -> Column:
    """start + (end - start) DIV 2 days; integer days, truncated toward zero."""
    half = (F.datediff(_c(end), _c(start)) / F.lit(2)).cast("int")
    return F.date_add(_c(start), half)


def midpoint_fractional(start, end) -> Column:
    """start + (end - start) / 2 with sub-day precision (pandas variant);
    timestamp_ntz interval arithmetic, independent of the session time zone."""
    return as_ts(start) + (as_ts(end) - as_ts(start)) / F.lit(2)


def halfway_cutoff(created, start, end) -> Column:
    """GREATEST(created, midpoint) as timestamp_ntz (NULL-ignoring greatest)."""
    return F.greatest(as_ts(created), as_ts(midpoint_date(start, end)))


def calendar_parts(ts, prefix: str = "created") -> list[Column]:
    c = _c(ts)
    dow = weekday_mon0(c)
    return [
        dow.alias(f"{prefix}_dow"),
        (dow >= 5).cast("int").alias(f"{prefix}_is_weekend"),
        (dow == 4).cast("int").alias(f"{prefix}_is_friday"),
        F.month(c).alias(f"{prefix}_month"),
        F.quarter(c).alias(f"{prefix}_quarter"),
    ]
