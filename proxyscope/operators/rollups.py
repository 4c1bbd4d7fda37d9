"""Roll-ups of the reports onto fixed key sets, zeros kept.

The key sets are fixed (five status classes, seven weekdays), so instead of a
join against a literal frame each roll-up is one global aggregate with a
conditional count per key (partial aggregation in every task, a one-row
final merge), unpivoted with ``inline`` in display order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxyscope.functions.fields import STATUS_CLASSES, WEEKDAY_NAMES, status_class, weekday_sun0
from proxyscope.operators.filters import Bound, time_range
from proxyscope.operators.reports import top_countries


def status_classes(requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """D1: requests per status class (``class string, n bigint``): 2xx, 3xx, 4xx, 5xx, Other."""
    cls = status_class(F.col("status"))
    df = time_range(requests, start, end)
    row = df.agg(*[F.count_if(cls == k).alias(f"c{i}") for i, k in enumerate(STATUS_CLASSES)])
    pairs = [F.struct(F.lit(k).alias("class"), F.col(f"c{i}").alias("n")) for i, k in enumerate(STATUS_CLASSES)]
    return row.select(F.inline(F.array(*pairs)))


def weekday_totals(requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """D2: requests per weekday (``day int, name string, n bigint``), Sunday (0) to Saturday (6)."""
    day = weekday_sun0(F.col("ts"))
    df = time_range(requests, start, end)
    row = df.agg(*[F.count_if(day == i).alias(f"c{i}") for i in range(len(WEEKDAY_NAMES))])
    triples = [
        F.struct(F.lit(i).alias("day"), F.lit(name).alias("name"), F.col(f"c{i}").alias("n"))
        for i, name in enumerate(WEEKDAY_NAMES)
    ]
    return row.select(F.inline(F.array(*triples)))


def top_countries_10(requests: DataFrame, start: Bound = None, end: Bound = None) -> DataFrame:
    """D3: the first ten rows of the country report."""
    return top_countries(requests, start, end, limit=10)
