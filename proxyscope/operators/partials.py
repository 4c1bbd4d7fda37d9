"""Reports from hourly partials, with the hours cut by a bound read from the requests.

``merged`` gives rows that add up to the requested range: stored partial rows of the hours
that lie in it whole, and one row per request of the (at most two) hours that a bound cuts.
Without bounds, or with bounds at full hours, no request is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxyscope.functions.fields import STATUS_CLASSES, WEEKDAY_NAMES, hour_bucket, hour_text, status_class, utc_day
from proxyscope.operators.filters import Bound, bound_ts, time_range
from proxyscope.operators.reports import exact_sum
from proxyscope.sources.partials import KEYS, partial_columns

_HOUR_US = 3_600_000_000


def _hour_start(hour: Column) -> Column:
    return F.timestamp_micros(hour * F.lit(_HOUR_US))


def merged(partials: DataFrame, requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """(hour, status, browser, n, bytes_hi, bytes_lo) that add up to ``start <= ts <= end``."""
    values = ["n", "bytes_hi", "bytes_lo"]
    whole = partials
    if start is None and end is None:
        return whole.select(*KEYS, *values)
    edges, days, cut = time_range(requests, start, end), [], []
    if start is not None:
        low = bound_ts(start)
        first = -F.floor(-F.unix_micros(low) / F.lit(_HOUR_US))  # the first hour that starts at or after it
        whole = whole.where((F.col("hour") >= first) & (F.col("dt") >= utc_day(low)))
        # the first part is a constant: a bound at a full hour leaves nothing to read
        cut.append((_hour_start(first) > low) & (F.col("ts") < _hour_start(first)))
        days.append(utc_day(low))
    if end is not None:
        high = bound_ts(end)
        last = hour_bucket(F.timestamp_micros(F.unix_micros(high) + 1))  # the first hour that does not end at or before it
        whole = whole.where((F.col("hour") < last) & (F.col("dt") <= utc_day(high)))
        cut.append((_hour_start(last) <= high) & (F.col("ts") >= _hour_start(last)))
        days.append(utc_day(high))
    edges = edges.where(cut[0] | cut[1] if len(cut) == 2 else cut[0])
    if "dt" in edges.columns:  # each bound cuts an hour of its own day
        edges = edges.where(F.col("dt").isin(*days))
    one = edges.select(*partial_columns())
    low_high = [F.shiftright("bytes", 20).alias("bytes_hi"), F.col("bytes").bitwiseAND(F.lit((1 << 20) - 1)).alias("bytes_lo")]
    one = one.select(*KEYS, F.lit(1).cast("bigint").alias("n"), *low_high)
    return whole.select(*KEYS, *values).unionByName(one)


def _n() -> Column:
    return F.sum("n").alias("n")


def requests_over_time(partials: DataFrame, requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """R1 from partials."""
    out = merged(partials, requests, start, end).groupBy("hour").agg(_n()).orderBy("hour")
    return out.select(hour_text(F.col("hour")).alias("t"), "n")


def bandwidth_over_time(partials: DataFrame, requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """R5 from partials: sums stay exact, so the rounding is that of the scan."""
    rows = merged(partials, requests, start, end).groupBy("hour").agg(F.sum("bytes_hi").alias("b_hi"), F.sum("bytes_lo").alias("b_lo"))
    mb = F.rint(exact_sum("b").cast("double") / F.lit(1024.0) / F.lit(1024.0)).cast("bigint")
    return rows.orderBy("hour").select(hour_text(F.col("hour")).alias("t"), mb.alias("mb"))


def status_codes(partials: DataFrame, requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """R3 from partials."""
    out = merged(partials, requests, start, end).groupBy("status").agg(_n())
    return out.orderBy(F.col("n").desc(), F.col("status").asc_nulls_last())


def _weekday(hour: Column) -> Column:
    return F.pmod(F.floor(hour / 24) + 4, F.lit(7)).cast("int")  # 1970-01-01 was a Thursday


def hourly_heatmap(partials: DataFrame, requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """R6 from partials."""
    h = F.col("hour")
    rows = merged(partials, requests, start, end).select(F.pmod(h, F.lit(24)).cast("int").alias("hour"), _weekday(h).alias("day"), "n")
    return rows.groupBy("hour", "day").agg(_n()).orderBy("hour", "day")


def user_agents(partials: DataFrame, requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """R9 from partials."""
    out = merged(partials, requests, start, end).where(F.col("browser").isNotNull()).groupBy("browser").agg(_n())
    return out.orderBy(F.col("n").desc(), F.col("browser").asc_nulls_last())


def status_classes(partials: DataFrame, requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """D1 from partials: five rows, zeros kept."""
    cls = status_class(F.col("status"))
    counts = [F.coalesce(F.sum(F.when(cls == k, F.col("n"))), F.lit(0).cast("bigint")).alias(f"c{i}") for i, k in enumerate(STATUS_CLASSES)]
    row = merged(partials, requests, start, end).agg(*counts)
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("class"), F.col(f"c{i}").alias("n")) for i, k in enumerate(STATUS_CLASSES)])))


def weekday_totals(partials: DataFrame, requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """D2 from partials: seven rows, zeros kept."""
    day = _weekday(F.col("hour"))
    counts = [F.coalesce(F.sum(F.when(day == i, F.col("n"))), F.lit(0).cast("bigint")).alias(f"c{i}") for i in range(len(WEEKDAY_NAMES))]
    row = merged(partials, requests, start, end).agg(*counts)
    days = [F.struct(F.lit(i).alias("day"), F.lit(name).alias("name"), F.col(f"c{i}").alias("n")) for i, name in enumerate(WEEKDAY_NAMES)]
    return row.select(F.inline(F.array(*days)))


__all__ = [
    "merged", "requests_over_time", "bandwidth_over_time", "status_codes", "hourly_heatmap", "user_agents",
    "status_classes", "weekday_totals",
]
