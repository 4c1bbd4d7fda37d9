"""Named queries over the driver tables, for the correctness check and the benchmark.

Every query reads ``events`` and ``pages`` from ``sf_dir``, turns them into
log lines (``sources.fixtures``), parses them and runs one operator on the
result, so its work grows with the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proxyscope.operators import export as X
from proxyscope.operators import heavy_keys as H
from proxyscope.operators import parse as P
from proxyscope.operators import partials as M
from proxyscope.operators import reports as R
from proxyscope.operators import rollups as D
from proxyscope.session import use_utc
from proxyscope.sources import ledger as L
from proxyscope.sources import partials as T
from proxyscope.sources import table as S
from proxyscope.sources.scratch import shared_folder
from proxyscope.functions.url import with_url_parts
from proxyscope.sources.fixtures import fixture_lines, general_urls
from pyspark.sql import functions as F

# The time ranges of the bounded query variants (UTC).
RANGE_START = "2024-01-05 00:00:00"
RANGE_END = "2024-01-20 00:00:00"
FROM_START = "2024-01-25 00:00:00"
UNTIL_END = "2024-01-03 12:00:00"
NO_DATA = "2030-01-01 00:00:00"
FIRST_HOURS = 200

Query = Callable[[SparkSession, str], DataFrame]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_utc(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return fixture_lines(events, pages)


def parsed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_lines(log_lines(spark, sf_dir))


def _on_lines(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: op(log_lines(spark, sf_dir))


def _on_requests(op: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf_dir: op(parsed_requests(spark, sf_dir), *args, **kwargs)


def _on_days(op: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """On rows with the stored table's partition column, so that bounds also go through it."""
    return lambda spark, sf_dir: op(S.with_dt(parsed_requests(spark, sf_dir)), *args, **kwargs)


def url_parts_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = general_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return with_url_parts(urls, "url", "u").select("page_id", "url", "u.*")


RANGE = (RANGE_START, RANGE_END)
MID_HOURS = ("2024-01-05 07:20:30", "2024-01-20 18:45:59.999999")  # cut hours at both ends
ONE_HOUR = ("2024-01-05 07:20:30", "2024-01-05 07:40:00")

_STORED: dict[tuple[str, str], str] = {}


def stored_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, hourly partials, rejects) as an import leaves them: the lines are written as log files
    below the shared folder and imported by two runs, each of which refreshes the partials.
    Made once per application and folder of tables."""
    use_utc(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        root = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
        lines = log_lines(spark, sf_dir).withColumn("half", F.pmod(F.xxhash64("value"), F.lit(2)))
        lines.write.partitionBy("half").text(f"{root}/logs")
        for half in range(2):
            S.import_logs(spark, f"{root}/logs/half={half}", f"{root}/requests", keep_rejects=True)
            T.refresh_partials(spark, f"{root}/requests", f"{root}/partials")
        _STORED[key] = root
    root = _STORED[key]
    return S.load_requests(spark, f"{root}/requests"), T.load_partials(spark, f"{root}/partials"), S.load_rejects(spark, f"{root}/requests")


def _stored(op: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """On the stored table, read back from Parquet."""
    return lambda spark, sf_dir: op(stored_tables(spark, sf_dir)[0], *args, **kwargs)


def _partials(op: Callable[..., DataFrame], *args) -> Query:
    """On the stored table and its hourly partials."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        requests, partials, _ = stored_tables(spark, sf_dir)
        return op(partials, requests, *args)

    return query


def ledgered_table(spark: SparkSession, sf_dir: str) -> str:
    """Folder of a table filled by a directory import of half of the log files and a stream over all
    of them, each run twice; made once per application and folder of tables."""
    use_utc(spark)
    key = (spark.sparkContext.applicationId, sf_dir + "#ledger")
    if key not in _STORED:
        root = f"{shared_folder(spark)}/ledgered-{uuid.uuid4().hex}"
        lines = log_lines(spark, sf_dir).withColumn("half", F.pmod(F.xxhash64("value"), F.lit(2)))
        lines.write.partitionBy("half").text(f"{root}/logs")
        for _ in range(2):
            L.import_new(spark, f"{root}/logs/half=0", f"{root}/requests", pattern="*.txt")
            L.stream_into(spark, f"{root}/logs/half=*", f"{root}/requests", "lines", pattern="*.txt").awaitTermination()
        _STORED[key] = f"{root}/requests"
    return _STORED[key]


def ledger_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.load_ledgered(spark, ledgered_table(spark, sf_dir)).drop("dt")


def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import totals added up over the files of the ledger."""
    files = L.load_ledger(spark, ledgered_table(spark, sf_dir))
    return files.agg(*[F.sum(c).alias(c) for c in ("lines", "accepted", "rejected")])


def footer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored_tables(spark, sf_dir)
    return S.stored_coverage(spark, f"{_STORED[spark.sparkContext.applicationId, sf_dir]}/requests")


def stored_rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_tables(spark, sf_dir)[2]


def stored_host(requests: DataFrame) -> DataFrame:
    """Days of the host that ranks first by name, looked up in the stored table."""
    host = requests.agg(F.min("host")).first()[0]
    found = S.host_requests(requests, host)
    return found.groupBy("host", "dt", "status").agg(F.count(F.lit(1)).alias("n"))

QUERIES: dict[str, Query] = {
    "parse_requests": lambda spark, sf_dir: parsed_requests(spark, sf_dir),
    "rejected_lines": _on_lines(P.rejected_lines),
    "rejects_by_reason": _on_lines(P.rejects_by_reason),
    "import_totals": _on_lines(P.import_totals),
    "table_coverage": _on_requests(S.table_coverage),
    "url_parts": _on_requests(
        lambda df: df.groupBy("url", "scheme", "host", "port", "path", "query").agg(F.count(F.lit(1)).alias("n"))
    ),
    "url_parts_general": url_parts_general,
    "requests_over_time": _on_requests(R.requests_over_time),
    "requests_over_time_first_200": _on_requests(R.requests_over_time, first_hours=FIRST_HOURS),
    "bandwidth_over_time_first_200": _on_requests(R.bandwidth_over_time, first_hours=FIRST_HOURS),
    "bandwidth_over_time_until": _on_requests(R.bandwidth_over_time, None, UNTIL_END),
    "requests_over_time_range_dt": _on_days(R.requests_over_time, *RANGE),
    "top_hosts_range_dt": _on_days(R.top_hosts, *RANGE),
    "status_codes_until_dt": _on_days(R.status_codes, None, UNTIL_END),
    "requests_by_day": _on_days(lambda df: df.groupBy("dt").agg(F.count(F.lit(1)).alias("n"))),
    "top_hosts_from": _on_requests(R.top_hosts, FROM_START, None),
    "top_hosts_until": _on_requests(R.top_hosts, None, UNTIL_END),
    "status_codes_from": _on_requests(R.status_codes, FROM_START, None),
    "status_codes_until": _on_requests(R.status_codes, None, UNTIL_END),
    "top_countries_from": _on_requests(R.top_countries, FROM_START, None),
    "top_countries_until": _on_requests(R.top_countries, None, UNTIL_END),
    "top_hosts_no_data": _on_requests(R.top_hosts, NO_DATA, None),
    "report_document_no_data": _on_requests(X.all_reports, NO_DATA, None),
    "requests_over_time_range": _on_requests(R.requests_over_time, *RANGE),
    "requests_over_time_from": _on_requests(R.requests_over_time, FROM_START, None),
    "requests_over_time_until": _on_requests(R.requests_over_time, None, UNTIL_END),
    "top_hosts": _on_requests(R.top_hosts),
    "top_hosts_range": _on_requests(R.top_hosts, *RANGE),
    "status_codes": _on_requests(R.status_codes),
    "status_codes_range": _on_requests(R.status_codes, *RANGE),
    "top_countries": _on_requests(R.top_countries),
    "top_countries_range": _on_requests(R.top_countries, *RANGE),
    "top_countries_10": _on_requests(D.top_countries_10),
    "bandwidth_over_time": _on_requests(R.bandwidth_over_time),
    "bandwidth_over_time_range": _on_requests(R.bandwidth_over_time, *RANGE),
    "bandwidth_over_time_from": _on_requests(R.bandwidth_over_time, FROM_START, None),
    "hourly_heatmap": _on_requests(R.hourly_heatmap),
    "hourly_heatmap_range": _on_requests(R.hourly_heatmap, *RANGE),
    "error_analysis": _on_requests(R.error_analysis),
    "error_analysis_range": _on_requests(R.error_analysis, *RANGE),
    "top_paths": _on_requests(R.top_paths),
    "top_paths_range": _on_requests(R.top_paths, *RANGE),
    "user_agents": _on_requests(R.user_agents),
    "user_agents_range": _on_requests(R.user_agents, *RANGE),
    "status_classes": _on_requests(D.status_classes),
    "status_classes_range": _on_requests(D.status_classes, *RANGE),
    "weekday_totals": _on_requests(D.weekday_totals),
    "weekday_totals_range": _on_requests(D.weekday_totals, *RANGE),
    "report_document": _on_requests(X.all_reports),
    "stored_requests": _stored(lambda df: df.drop("dt")),
    "stored_rejected_lines": stored_rejected_lines,
    "stored_requests_by_day": _stored(lambda df: df.groupBy("dt").agg(F.count(F.lit(1)).alias("n"))),
    "stored_coverage": _stored(S.table_coverage),
    "stored_host": _stored(stored_host),
    "footer_coverage": footer_coverage,
    "ledger_requests": ledger_requests,
    "ledger_totals": ledger_totals,
    "stored_top_countries_range": _stored(R.top_countries, *RANGE),
    "partials_requests_over_time": _partials(M.requests_over_time),
    "partials_requests_over_time_mid": _partials(M.requests_over_time, *MID_HOURS),
    "partials_requests_over_time_hour": _partials(M.requests_over_time, *ONE_HOUR),
    "partials_bandwidth_over_time_mid": _partials(M.bandwidth_over_time, *MID_HOURS),
    "partials_status_codes_mid": _partials(M.status_codes, *MID_HOURS),
    "partials_status_codes_from": _partials(M.status_codes, FROM_START, None),
    "partials_hourly_heatmap_until": _partials(M.hourly_heatmap, None, UNTIL_END),
    "partials_user_agents_mid": _partials(M.user_agents, *MID_HOURS),
    "partials_status_classes_mid": _partials(M.status_classes, *MID_HOURS),
    "partials_weekday_totals_range": _partials(M.weekday_totals, *RANGE),
    "partials_weekday_totals_no_data": _partials(M.weekday_totals, NO_DATA, None),
    "two_pass_top_hosts": _stored(H.top_hosts),
    "two_pass_top_paths": _stored(H.top_paths),
    "two_pass_top_paths_range": _stored(H.top_paths, *RANGE),
}

__all__ = ["QUERIES", "MID_HOURS", "ONE_HOUR", "stored_tables", "RANGE_START", "RANGE_END", "FROM_START", "UNTIL_END", "log_lines", "parsed_requests"]
