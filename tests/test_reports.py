"""Reports and roll-ups on hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from proxyscope.operators import reports as R
from proxyscope.operators import rollups as D
from proxyscope.operators.export import all_reports, report_document
from proxyscope.schema import REQUESTS_SCHEMA

MB = 1024 * 1024


def _requests(spark, rows):
    """rows: dicts with some of ts, host, status, bytes, country, path, user_agent."""
    full = []
    for r in rows:
        full.append(
            (
                r.get("ts", dt.datetime(2026, 2, 15, 10, 30)),
                "10.0.0.1", None, None, "GET", "http://x/", "http",
                r.get("host"), None, r.get("path"), None, "HTTP/1.1",
                r.get("status", 200), r.get("bytes"), r.get("country"), r.get("user_agent"), "raw",
            )
        )
    return spark.createDataFrame(full, REQUESTS_SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return _requests(spark, [])


def test_top_hosts_ties_and_limit(spark):
    rows = [{"host": h} for h in ["b", "a", "c", "a", "b", "d"]] + [{"host": None}] * 5
    out = [tuple(r) for r in R.top_hosts(_requests(spark, rows), limit=3).collect()]
    assert out == [("a", 2), ("b", 2), ("c", 1)]


def test_error_analysis_keeps_null_host(spark):
    rows = [{"host": None, "status": 500}, {"host": None, "status": 404}, {"host": "a", "status": 503},
            {"host": "a", "status": 200}, {"host": "b", "status": 600}]
    out = [tuple(r) for r in R.error_analysis(_requests(spark, rows)).collect()]
    assert out == [(None, 2, 1, 1), ("a", 1, 1, 0), ("b", 1, 1, 0)]


def test_requests_over_time_text_and_bounds(spark):
    t0 = dt.datetime(2026, 2, 15, 0, 0, 0)
    rows = [{"ts": t0}, {"ts": t0 + dt.timedelta(minutes=59)}, {"ts": t0 + dt.timedelta(hours=1)},
            {"ts": t0 + dt.timedelta(hours=2, seconds=1)}]
    df = _requests(spark, rows)
    assert [tuple(r) for r in R.requests_over_time(df).collect()] == [
        ("2026-02-15 00:00:00+00", 2), ("2026-02-15 01:00:00+00", 1), ("2026-02-15 02:00:00+00", 1)]
    # both ends inclusive: exact hits count
    got = R.requests_over_time(df, "2026-02-15 00:59:00", "2026-02-15 01:00:00").collect()
    assert [tuple(r) for r in got] == [("2026-02-15 00:00:00+00", 1), ("2026-02-15 01:00:00+00", 1)]
    assert R.requests_over_time(df, "2026-02-16", "2026-02-15").count() == 0
    assert R.requests_over_time(df, start="2026-02-15 02:00:00").count() == 1
    assert R.requests_over_time(df, end="2026-02-15 00:00:00").count() == 1


def test_unparsable_bound_raises(spark):
    df = _requests(spark, [{}])
    with pytest.raises(Exception):
        R.top_hosts(df, "not a time").collect()


def test_series_limit_only_when_unbounded(spark):
    t0 = dt.datetime(2026, 1, 1)
    df = _requests(spark, [{"ts": t0 + dt.timedelta(hours=i)} for i in range(230)])
    assert R.requests_over_time(df).count() > 200
    assert R.requests_over_time(df, first_hours=200).collect() == R.requests_over_time(df).collect()[:200]
    assert R.requests_over_time(df).first().t == "2026-01-01 00:00:00+00"
    assert R.requests_over_time(df, "2026-01-01", "2026-02-01").count() == 230
    assert R.bandwidth_over_time(df, first_hours=200).collect() == R.bandwidth_over_time(df).collect()[:200]


def test_bandwidth_rounds_half_to_even(spark):
    t0 = dt.datetime(2026, 2, 15)
    rows = []
    for h, total in enumerate([MB // 2, 3 * MB // 2, 5 * MB // 2, MB // 2 + 1]):
        rows += [{"ts": t0 + dt.timedelta(hours=h), "bytes": total - 10}, {"ts": t0 + dt.timedelta(hours=h), "bytes": 10}]
    rows.append({"ts": t0, "bytes": None})
    out = [r.mb for r in R.bandwidth_over_time(_requests(spark, rows)).collect()]
    assert out == [0, 2, 2, 1]


def test_bandwidth_exact_for_huge_sums(spark):
    big = 9_000_000_000_000_000_000  # two of these overflow a bigint sum
    rows = [{"bytes": big}, {"bytes": big}]
    out = R.bandwidth_over_time(_requests(spark, rows)).first().mb
    assert out == round(2 * big / MB)


def test_top_paths_avg_truncates(spark):
    rows = [{"path": "/a", "bytes": 2047}, {"path": "/a", "bytes": None}, {"path": "/", "bytes": 5},
            {"path": "443", "bytes": 4096}, {"path": None}]
    out = [tuple(r) for r in R.top_paths(_requests(spark, rows)).collect()]
    assert out == [("/a", 2, 0), ("443", 1, 4)]


def test_user_agent_families(spark):
    uas = {
        "Mozilla/5.0 Chrome/120.0 Safari/537.36": "Chrome",
        "Mozilla/5.0 Chrome/120.0 Safari/537.36 Edg/120.0": "Edge",
        "Mozilla/5.0 Gecko/20100101 Firefox/121.0": "Firefox",
        "Mozilla/5.0 Version/17.2 Safari/605.1.15": "Safari",
        "Opera/9.80 Presto/2.12": "Opera",
        "Mozilla/5.0 Chrome/120 OPR/106": "Chrome",
        "Googlebot/2.1": "Bot",
        "crawler bot": "Bot",
        "-": "Other",
    }
    df = _requests(spark, [{"user_agent": u} for u in uas] + [{"user_agent": None}])
    got = {r.browser: r.n for r in R.user_agents(df).collect()}
    want: dict[str, int] = {}
    for fam in uas.values():
        want[fam] = want.get(fam, 0) + 1
    assert got == want


def test_heatmap_weekday_sunday_zero(spark):
    sunday = dt.datetime(2026, 2, 15, 13, 5)  # a Sunday
    df = _requests(spark, [{"ts": sunday}, {"ts": sunday + dt.timedelta(days=1)}])
    assert [tuple(r) for r in R.hourly_heatmap(df).collect()] == [(13, 0, 1), (13, 1, 1)]


def test_rollups_keep_zeros(spark, empty):
    assert [tuple(r) for r in D.status_classes(empty).collect()] == [
        ("2xx", 0), ("3xx", 0), ("4xx", 0), ("5xx", 0), ("Other", 0)]
    assert [tuple(r) for r in D.weekday_totals(empty).collect()] == [
        (0, "Sun", 0), (1, "Mon", 0), (2, "Tue", 0), (3, "Wed", 0), (4, "Thu", 0), (5, "Fri", 0), (6, "Sat", 0)]


def test_status_classes(spark):
    df = _requests(spark, [{"status": s} for s in [101, 200, 204, 302, 404, 500, 503, 600]])
    assert dict(tuple(r) for r in D.status_classes(df).collect()) == {
        "2xx": 2, "3xx": 1, "4xx": 1, "5xx": 2, "Other": 2}


def test_empty_reports(spark, empty):
    for fn in (R.requests_over_time, R.top_hosts, R.status_codes, R.top_countries, R.bandwidth_over_time,
               R.hourly_heatmap, R.error_analysis, R.top_paths, R.user_agents):
        assert fn(empty).count() == 0


def test_countries_filter_empty(spark):
    df = _requests(spark, [{"country": "US"}, {"country": ""}, {"country": None}, {"country": "-"}])
    assert sorted(tuple(r) for r in R.top_countries(df).collect()) == [("-", 1), ("US", 1)]


def test_report_document_json(spark):
    rows = [{"host": "a"}, {"host": "b"}, {"host": "b"}]
    doc = report_document("top_hosts", R.top_hosts(_requests(spark, rows))).first()
    assert doc.report == "top_hosts"
    assert doc.doc == '{"hosts":[{"host":"b","n":2},{"host":"a","n":1}]}'
    err = report_document("error_analysis", R.error_analysis(_requests(spark, [{"status": 500}]))).first()
    assert err.doc == '{"hosts":[{"host":null,"errors":1,"server_errors":1,"client_errors":0}]}'


def test_all_reports_names(spark):
    df = _requests(spark, [{"host": "a", "status": 404, "path": "/x", "user_agent": "curl", "country": "US"}])
    names = [r.report for r in all_reports(df).collect()]
    assert sorted(names) == sorted([
        "requests_over_time", "top_hosts", "status_codes", "top_countries", "bandwidth_over_time",
        "hourly_heatmap", "error_analysis", "top_paths", "user_agents", "status_classes", "weekday_totals"])


def test_invariants(spark):
    from proxyscope.plans.registry import parsed_requests

    df = parsed_requests(spark, "/root/testdata/sf0.001").cache()
    n = df.count()
    assert R.status_codes(df).agg(F.sum("n")).first()[0] == n
    assert R.hourly_heatmap(df).agg(F.sum("n")).first()[0] == n
    assert D.weekday_totals(df).agg(F.sum("n")).first()[0] == n
    assert D.status_classes(df).agg(F.sum("n")).first()[0] == n
    for r in R.error_analysis(df, limit=None).collect():
        assert r.errors == r.server_errors + r.client_errors
    df.unpersist()


@pytest.mark.parametrize("bounds", [(None, None), ("2024-01-03 00:00:00", "2024-01-05 12:00:00"), ("2030-01-01", None)])
def test_dashboard_equals_single_reports(spark, bounds):
    from proxyscope.operators.export import REPORTS
    from proxyscope.plans.registry import parsed_requests

    df = parsed_requests(spark, "/root/testdata/sf0.001").cache()
    documents = {r.report: r.doc for r in all_reports(df, *bounds).collect()}
    for name, spec in REPORTS.items():
        assert documents[name] == report_document(name, spec.fn(df, *bounds)).first().doc, name
    df.unpersist()


def test_dashboard_is_lazy_and_keeps_paths_apart(spark, tmp_path):
    from proxyscope.sources.table import append_requests, load_requests

    append_requests(_requests(spark, [{"host": "a", "path": "/x"}]), f"{tmp_path}/t")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    df = all_reports(load_requests(spark, f"{tmp_path}/t"))
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert len(scans) == 5
    assert sum("path:string" in line for line in scans) == 1
    assert any(line.rstrip().endswith("ReadSchema: struct<path:string,bytes:bigint>") or "struct<bytes:bigint,path:string>" in line for line in scans)


def test_zone_of_the_session_does_not_matter(spark, tmp_path):
    """Rows written in one zone and read in another: all of a day's hours, under UTC keys."""
    from proxyscope.operators.parse import parse_lines
    from proxyscope.sources.table import append_requests, load_requests
    from conftest import lines_df, make_line

    lines = [make_line(ts=f"15/Feb/2026:{h:02d}:10:00 +0000", url="http://a.example/x") for h in range(24)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        append_requests(parse_lines(lines_df(spark, lines)), f"{tmp_path}/t")
        seen = {}
        for other in ("UTC", "Asia/Kolkata", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            t = load_requests(spark, f"{tmp_path}/t")
            day = ("2026-02-15 00:00:00", "2026-02-15 23:59:59")
            assert [tuple(r) for r in R.top_hosts(t, *day).collect()] == [("a.example", 24)]
            assert R.top_hosts(t, "2026-02-15 05:00:00-05:00", None).first().n == 14
            seen[other] = (
                [tuple(r) for r in R.requests_over_time(t, *day).collect()],
                [tuple(r) for r in R.hourly_heatmap(t).collect()],
            )
        assert seen["UTC"] == seen["Asia/Kolkata"] == seen["America/New_York"]
        assert seen["UTC"][0][0] == ("2026-02-15 00:00:00+00", 1) and seen["UTC"][1][0] == (0, 0, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
