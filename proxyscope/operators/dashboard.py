"""The reports with few keys from one scan, as documents.

Hours, statuses, browser families and hour-of-day x weekday cells are few, so their counts
come from one ``GROUPING SETS`` aggregate (partial aggregation before a single shuffle) and
their seven documents from one more aggregate over its small result. Hosts, countries and
paths may be many: each of their four reports is a scan of its own two columns with its own
top-k, so a long list of paths never shares a hash table with the rest. Nothing is written
and nothing runs before the caller acts on the frame.

The documents equal those of the standalone reports (checked in the tests).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxyscope.functions.fields import (
    STATUS_CLASSES,
    WEEKDAY_NAMES,
    browser_family,
    hour_bucket,
    hour_of_day,
    hour_text,
    status_class,
    weekday_sun0,
)
from proxyscope.operators.filters import Bound, time_range
from proxyscope.operators.reports import exact_sum, exact_sum_parts

KEYS = ["h", "status", "browser", "hod", "dow"]
SETS = {"hour": ["h"], "status": ["status"], "browser": ["browser"], "cell": ["hod", "dow"]}
# grouping_id(): bit (n-1-i) is set when KEYS[i] is not part of the set.
GID = {
    name: sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in cols) for name, cols in SETS.items()
}


def small_groups(requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """One aggregate: a row per (grouping set, key) of the small key sets."""
    ts, ua = F.col("ts"), F.col("user_agent")
    rows = time_range(requests, start, end).select(
        hour_bucket(ts).alias("h"),
        "status",
        F.when(ua.isNotNull(), browser_family(ua)).alias("browser"),
        hour_of_day(ts).alias("hod"),
        weekday_sun0(ts).alias("dow"),
        F.coalesce(F.col("bytes"), F.lit(0).cast("bigint")).alias("b"),
    )
    return rows.groupingSets([SETS[name] for name in SETS], *KEYS).agg(
        F.count(F.lit(1)).alias("n"), *exact_sum_parts(F.col("b"), "b"), F.grouping_id().alias("gid")
    )


def _rows(name: str, *fields: Column) -> Column:
    """The rows of one set as an array, ordered by their fields."""
    return F.array_sort(F.collect_list(F.when(F.col("gid") == GID[name], F.struct(*fields))))


def _total(rows: str, key, value) -> Column:
    """Sum of ``n`` over the rows whose ``key`` is ``value``."""
    chosen = F.filter(rows, lambda r: key(r) == F.lit(value))
    return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda total, r: total + r["n"])


def small_documents(requests: DataFrame, start: Bound = None, end: Bound = None, first_hours: int | None = None) -> DataFrame:
    """``report``, ``doc`` of the seven reports with few keys."""
    mb = F.rint(exact_sum("b").cast("double") / F.lit(1024.0) / F.lit(1024.0)).cast("bigint")
    n, less = F.col("n"), (-F.col("n")).alias("less")
    one = small_groups(requests, start, end).agg(
        _rows("hour", F.col("h"), n, mb.alias("mb")).alias("hours"),
        _rows("status", less, F.col("status"), n).alias("statuses"),
        _rows("browser", less, F.col("browser"), n).alias("browsers"),
        _rows("cell", F.col("hod").alias("hour"), F.col("dow").alias("day"), n).alias("cells"),
    )
    hours = F.col("hours") if first_hours is None else F.slice("hours", 1, first_hours)

    def picked(rows: Column | str, *fields: str) -> Column:
        return F.transform(rows, lambda r: F.struct(*[r[f].alias(f) for f in fields]))

    def series(field: str) -> Column:
        return F.transform(hours, lambda r: F.struct(hour_text(r["h"]).alias("t"), r[field].alias(field)))

    classes = F.array(*[
        F.struct(F.lit(c).alias("class"), _total("statuses", lambda r: status_class(r["status"]), c).alias("n"))
        for c in STATUS_CLASSES
    ])
    days = F.array(*[
        F.struct(F.lit(i).alias("day"), F.lit(name).alias("name"), _total("cells", lambda r: r["day"], i).alias("n"))
        for i, name in enumerate(WEEKDAY_NAMES)
    ])
    known = F.filter("browsers", lambda r: r["browser"].isNotNull())
    arrays = {
        "requests_over_time": ("series", series("n")),
        "status_codes": ("status", picked("statuses", "status", "n")),
        "bandwidth_over_time": ("series", series("mb")),
        "hourly_heatmap": ("data", picked("cells", "hour", "day", "n")),
        "user_agents": ("browsers", picked(known, "browser", "n")),
        "status_classes": ("classes", classes),
        "weekday_totals": ("days", days),
    }
    documents = [
        F.struct(F.lit(name).alias("report"), F.to_json(F.struct(rows.alias(key)), {"ignoreNullFields": "false"}).alias("doc"))
        for name, (key, rows) in arrays.items()
    ]
    return one.select(F.inline(F.array(*documents)))
