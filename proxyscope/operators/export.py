"""Report documents: each report as one JSON object ``{key: [rows...]}``.

The array is assembled by Spark (``collect_list`` + ``sort_array`` on an
explicit order key) from the report's output, which is bounded by the
report's own limit or key space: one row per hour of the requested range, 1000
statuses, 168 heat-map cells, 7 browsers. No unbounded data passes through one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxyscope.operators import reports as R
from proxyscope.operators import rollups as D
from proxyscope.operators.filters import Bound


@dataclass(frozen=True)
class Report:
    fn: Callable[..., DataFrame]
    key: str  # name of the JSON array
    order: tuple[tuple[str, str], ...]  # (column, "asc" | "desc" | "asc_nulls_last")


# The report documents, their JSON keys and row order.
REPORTS: dict[str, Report] = {
    "requests_over_time": Report(R.requests_over_time, "series", (("t", "asc"),)),
    "top_hosts": Report(R.top_hosts, "hosts", (("n", "desc"), ("host", "asc_nulls_last"))),
    "status_codes": Report(R.status_codes, "status", (("n", "desc"), ("status", "asc_nulls_last"))),
    "top_countries": Report(R.top_countries, "countries", (("n", "desc"), ("country", "asc_nulls_last"))),
    "bandwidth_over_time": Report(R.bandwidth_over_time, "series", (("t", "asc"),)),
    "hourly_heatmap": Report(R.hourly_heatmap, "data", (("hour", "asc"), ("day", "asc"))),
    "error_analysis": Report(R.error_analysis, "hosts", (("errors", "desc"), ("host", "asc_nulls_last"))),
    "top_paths": Report(R.top_paths, "paths", (("n", "desc"), ("path", "asc_nulls_last"))),
    "user_agents": Report(R.user_agents, "browsers", (("n", "desc"), ("browser", "asc_nulls_last"))),
    "status_classes": Report(D.status_classes, "classes", (("_pos", "asc"),)),
    "weekday_totals": Report(D.weekday_totals, "days", (("day", "asc"),)),
}

_ORDER_POS = {"status_classes": ("class", ("2xx", "3xx", "4xx", "5xx", "Other"))}


def _sort_keys(df: DataFrame, order: tuple[tuple[str, str], ...]) -> list[Column]:
    keys: list[Column] = []
    for col, how in order:
        c = F.col(col)
        if how == "desc":
            keys.append(-c)
        elif how == "asc_nulls_last":
            keys.extend([c.isNull(), c])
        else:
            keys.append(c)
    return keys


def report_document(name: str, report: DataFrame) -> DataFrame:
    """One row: ``report`` (name) and ``doc`` (JSON text) of an already computed report frame."""
    spec = REPORTS[name]
    payload = F.struct(*[F.col(c) for c in report.columns])
    df = report
    if name in _ORDER_POS:
        col, values = _ORDER_POS[name]
        df = df.withColumn("_pos", F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col)))
    keys = _sort_keys(df, spec.order)
    entry = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], payload.alias("v"))
    rows = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["v"])
    doc = F.to_json(F.struct(rows.alias(spec.key)), {"ignoreNullFields": "false"})
    return df.agg(doc.alias("doc")).select(F.lit(name).alias("report"), "doc")


SMALL = ("requests_over_time", "status_codes", "bandwidth_over_time", "hourly_heatmap", "user_agents", "status_classes", "weekday_totals")


def all_reports(requests: DataFrame, start: Bound = None, end: Bound = None, first_hours: int | None = None) -> DataFrame:
    """The dashboard: every report document for one time range (``report``, ``doc``).

    Lazy: five aggregates in one plan, one for all reports with few keys
    (``operators.dashboard``) and one for each report on hosts, countries and paths.
    """
    from proxyscope.operators.dashboard import small_documents

    out = small_documents(requests, start, end, first_hours)
    for name, report in REPORTS.items():
        if name not in SMALL:
            out = out.unionByName(report_document(name, report.fn(requests, start, end)))
    return out
