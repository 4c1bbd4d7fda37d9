"""The nine usage reports over ``requests``.

Each report is ``(requests, start=None, end=None) -> DataFrame`` with a fixed
schema. Plans: scan (pruned to the used columns, bounds pushed to Parquet and
to ``dt`` partitions) -> partial hash aggregate in every task -> one shuffle
of per-task partial results -> final aggregate -> ordered top-k
(``TakeOrderedAndProject``) where a limit applies. A hot key (one host with a
third of all rows) is collapsed by the partial aggregate before the shuffle,
so it never lands on one task.

Ties in ``ORDER BY n DESC LIMIT k`` are broken by the group key ascending,
NULLs last, so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxyscope.functions.fields import browser_family, hour_bucket, hour_of_day, hour_text, weekday_sun0
from proxyscope.operators.filters import Bound, time_range

# Report sizes.
TOP_HOSTS = 15
TOP_COUNTRIES = 20
TOP_ERROR_HOSTS = 10
TOP_PATHS = 15

_LOW_BITS = 20
_LOW_MASK = (1 << _LOW_BITS) - 1


def _count() -> Column:
    return F.count(F.lit(1)).alias("n")


def exact_sum_parts(c: Column, prefix: str) -> list[Column]:
    """Two bigint partial sums that together hold ``sum(c)`` exactly.

    Each value is split into its high part (``c >> 20``) and low 20 bits, so
    neither sum can overflow for any realistic group, and both stay plain
    long additions in generated code (a wide decimal sum would not).
    """
    return [
        F.sum(F.shiftright(c, _LOW_BITS)).alias(f"{prefix}_hi"),
        F.sum(c.bitwiseAND(F.lit(_LOW_MASK))).alias(f"{prefix}_lo"),
    ]


def exact_sum(prefix: str) -> Column:
    """Recombine :func:`exact_sum_parts` into a decimal(38,0) total."""
    hi = F.col(f"{prefix}_hi").cast("decimal(38,0)")
    lo = F.col(f"{prefix}_lo").cast("decimal(38,0)")
    return (hi * F.lit(1 << _LOW_BITS).cast("decimal(38,0)") + lo).cast("decimal(38,0)")


def _by_count(df: DataFrame, key: str, limit: int | None) -> DataFrame:
    out = df.orderBy(F.col("n").desc(), F.col(key).asc_nulls_last())
    return out.limit(limit) if limit is not None else out


def _first(df: DataFrame, first_hours: int | None) -> DataFrame:
    return df if first_hours is None else df.limit(first_hours)


def requests_over_time(
    requests: DataFrame, start: Bound = None, end: Bound = None, first_hours: int | None = None
) -> DataFrame:
    """R1: requests per hour (``t string, n bigint``), all hours; ``first_hours`` keeps the earliest ones."""
    df = time_range(requests, start, end).select(hour_bucket(F.col("ts")).alias("h"))
    out = _first(df.groupBy("h").agg(_count()).orderBy("h"), first_hours)
    return out.select(hour_text(F.col("h")).alias("t"), "n")


def top_hosts(requests: DataFrame, start: Bound = None, end: Bound = None, limit: int = TOP_HOSTS) -> DataFrame:
    """R2: the busiest hosts (``host string, n bigint``)."""
    df = time_range(requests, start, end).where(F.col("host").isNotNull())
    return _by_count(df.groupBy("host").agg(_count()), "host", limit)


def status_codes(requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """R3: requests per status (``status int, n bigint``), all statuses."""
    df = time_range(requests, start, end)
    return _by_count(df.groupBy("status").agg(_count()), "status", None)


def top_countries(
    requests: DataFrame, start: Bound = None, end: Bound = None, limit: int = TOP_COUNTRIES
) -> DataFrame:
    """R4: the most frequent countries (``country string, n bigint``)."""
    df = time_range(requests, start, end).where(F.col("country").isNotNull() & (F.col("country") != ""))
    return _by_count(df.groupBy("country").agg(_count()), "country", limit)


def bandwidth_over_time(
    requests: DataFrame, start: Bound = None, end: Bound = None, first_hours: int | None = None
) -> DataFrame:
    """R5: megabytes per hour (``t string, mb bigint``), rounded half to even.

    Both bounds are honoured; ``first_hours`` keeps the earliest hours only.
    """
    df = time_range(requests, start, end).select(
        hour_bucket(F.col("ts")).alias("h"), F.coalesce(F.col("bytes"), F.lit(0).cast("bigint")).alias("b")
    )
    out = _first(df.groupBy("h").agg(*exact_sum_parts(F.col("b"), "b")).orderBy("h"), first_hours)
    mb = F.rint(exact_sum("b").cast("double") / F.lit(1024.0) / F.lit(1024.0)).cast("bigint")
    return out.select(hour_text(F.col("h")).alias("t"), mb.alias("mb"))


def hourly_heatmap(requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """R6: requests per (hour of day, weekday with Sunday = 0) (``hour int, day int, n bigint``)."""
    df = time_range(requests, start, end).select(
        hour_of_day(F.col("ts")).alias("hour"), weekday_sun0(F.col("ts")).alias("day")
    )
    return df.groupBy("hour", "day").agg(_count()).orderBy("hour", "day")


def error_analysis(
    requests: DataFrame, start: Bound = None, end: Bound = None, limit: int = TOP_ERROR_HOSTS
) -> DataFrame:
    """R7: hosts with the most 4xx/5xx responses; the NULL host is a group of its own."""
    df = time_range(requests, start, end).where(F.col("status") >= 400)
    agg = df.groupBy("host").agg(
        F.count(F.lit(1)).alias("errors"),
        F.count_if(F.col("status") >= 500).alias("server_errors"),
        F.count_if((F.col("status") >= 400) & (F.col("status") < 500)).alias("client_errors"),
    )
    out = agg.orderBy(F.col("errors").desc(), F.col("host").asc_nulls_last())
    return out.limit(limit) if limit is not None else out


def top_paths(requests: DataFrame, start: Bound = None, end: Bound = None, limit: int = TOP_PATHS) -> DataFrame:
    """R8: most requested paths across hosts, with the mean size in KiB truncated toward zero."""
    df = time_range(requests, start, end).where(F.col("path").isNotNull() & (F.col("path") != "/"))
    b = F.coalesce(F.col("bytes"), F.lit(0).cast("bigint"))
    agg = df.groupBy("path").agg(_count(), *exact_sum_parts(b, "b"))
    top = _by_count(agg, "path", limit)
    avg = exact_sum("b").cast("double") / F.col("n").cast("double")
    return top.select("path", "n", (avg / F.lit(1024.0)).cast("bigint").alias("avg_kb"))


def user_agents(requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """R9: requests per browser family (``browser string, n bigint``)."""
    df = time_range(requests, start, end).where(F.col("user_agent").isNotNull())
    agg = df.groupBy(browser_family(F.col("user_agent")).alias("browser")).agg(_count())
    return _by_count(agg, "browser", None)
