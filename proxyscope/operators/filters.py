"""Time-range predicate shared by all reports.

Both ends are inclusive and optional. Bound text without a zone is read as UTC whatever the
session's zone; text that is no timestamp raises instead of silently matching nothing. On
the stored table the same bounds are also applied to the ``dt`` partition column, which is
what lets Parquet partition pruning skip whole days. ``dt`` and its bounds are UTC days
computed from the instant (``functions.fields.utc_day``), so the extra predicate never
drops a matching row.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxyscope.functions.fields import utc_day

Bound = str | _dt.datetime | None

# A zone can only follow a time of day: hours and minutes, then an offset or a zone name.
_HAS_ZONE = re.compile(r":\d{1,2}(?:\.\d+)?\s*(?:[zZ]|[A-Za-z][A-Za-z_/]+\S*|[+-]\d{1,2}(?::?\d{2}){0,2})\s*$")


def bound_ts(value: Bound) -> Column:
    if isinstance(value, _dt.datetime):
        aware = value if value.tzinfo else value.replace(tzinfo=_dt.timezone.utc)
        return F.lit(aware).cast("timestamp")
    text = str(value)
    if _HAS_ZONE.search(text):
        return F.lit(text).cast("timestamp")
    wall = F.lit(text).cast("timestamp_ntz")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, wall))


def time_range(df: DataFrame, start: Bound = None, end: Bound = None, ts_col: str = "ts") -> DataFrame:
    """Rows of ``df`` with ``start <= ts <= end`` (each bound optional)."""
    has_dt = "dt" in df.columns
    if start is not None:
        lo = bound_ts(start)
        df = df.where(F.col(ts_col) >= lo)
        if has_dt:
            df = df.where(F.col("dt") >= utc_day(lo))
    if end is not None:
        hi = bound_ts(end)
        df = df.where(F.col(ts_col) <= hi)
        if has_dt:
            df = df.where(F.col("dt") <= utc_day(hi))
    return df
