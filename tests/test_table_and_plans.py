"""Text in, Parquet out, and the physical plans the reports get."""

import os
import tempfile

from conftest import make_line

from proxyscope.operators import reports as R
from proxyscope.operators.parse import classify_lines, parse_lines
from proxyscope.sources.table import import_logs, load_requests, table_coverage
from proxyscope.sources.text import file_totals, read_lines


def _write_logs(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, data in files.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_read_lines_line_ends_and_utf8(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    good = make_line().encode()
    data = good + b"\r\n" + good.replace(b"US", b"U\rS") + b"\n" + b"\xff\xfe bad\n" + b"\n" + good
    _write_logs(root, {"a.log": data})
    lines = read_lines(spark, f"{root}/*.log")
    values = [r.value for r in lines.collect()]
    assert len(values) == 5  # a lone CR does not split a line
    assert values[0] == make_line()  # CR before LF dropped
    reasons = [r.reason for r in classify_lines(lines).collect()]
    assert reasons == [None, None, "invalid_utf8", "no_match", None]


def test_import_round_trip_and_pruning(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    day1 = [make_line(ts=f"15/Feb/2026:0{h}:00:00 +0000", url=f"http://h{h % 2}.example.com/p") for h in range(6)]
    day2 = [make_line(ts="16/Feb/2026:12:00:00 +0000"), "junk"]
    _write_logs(f"{root}/logs", {"a.log": "\n".join(day1).encode(), "b.log": "\n".join(day2).encode()})
    totals = import_logs(spark, f"{root}/logs/*.log", f"{root}/requests")
    assert (totals["lines"], totals["accepted"], totals["rejected"], totals["no_match"]) == (8, 7, 1, 1)
    assert sorted(d for d in os.listdir(f"{root}/requests") if d.startswith("dt=")) == ["dt=2026-02-15", "dt=2026-02-16"]

    table = load_requests(spark, f"{root}/requests")
    parsed = parse_lines(read_lines(spark, f"{root}/logs/*.log"))
    assert sorted(map(tuple, table.drop("dt").collect())) == sorted(map(tuple, parsed.collect()))
    cov = table_coverage(table).first()
    assert cov.n == 7

    bounded = R.top_hosts(table, "2026-02-16 00:00:00", "2026-02-16 23:59:59")
    plan = _plan(bounded)
    assert "PartitionFilters: [isnotnull(dt" in plan and "dt#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2026-02-16 00:00:00.0)" in plan
    assert "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<ts:timestamp,host:string>" in plan
    assert [tuple(r) for r in bounded.collect()] == [("www.example.org", 1)]

    per_file = {os.path.basename(r.file): (r.lines, r.accepted, r.rejected)
                for r in file_totals(classify_lines(read_lines(spark, f"{root}/logs/*.log", with_file=True))).collect()}
    assert per_file == {"a.log": (6, 6, 0), "b.log": (2, 1, 1)}


def test_no_python_in_plans(spark):
    from proxyscope.plans.registry import QUERIES

    for name in ("parse_requests", "top_hosts", "bandwidth_over_time", "status_classes"):
        plan = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas"):
            assert node not in plan, (name, node)


def test_partial_aggregation_before_shuffle(spark):
    from proxyscope.plans.registry import QUERIES

    plan = _plan(QUERIES["top_paths"](spark, "/root/testdata/sf0.001"))
    assert plan.count("HashAggregate") >= 2 and "partial_count" in plan


def test_import_plan_has_no_shuffle(spark):
    from proxyscope.sources.table import with_dt

    root = tempfile.mkdtemp(prefix="proxyscope-test-")
    _write_logs(f"{root}/logs", {"a.log": (make_line() + "\n").encode() * 3})
    out = with_dt(parse_lines(read_lines(spark, f"{root}/logs/*.log"))).sortWithinPartitions("dt", "ts")
    plan = _plan(out)
    assert "Exchange" not in plan and "Sort [dt" in plan


def test_url_split_keeps_generated_code(spark):
    """Only the general split (higher-order functions) runs outside whole-stage codegen, and as no column of its own."""
    from proxyscope.functions.url import url_parts_of

    df = spark.createDataFrame([("http://a.example/x?y",), ("www.example.org:443",), ("http://[::1]/a/../b",)], "url string")
    lines = [line.lstrip(" :+-") for line in _plan(url_parts_of(df, "url")).splitlines()]
    outside = [line for line in lines if line.startswith("Project")]
    assert len(outside) <= 1, outside
    assert not any(f"__{name}#" in line for line in lines for name in ("auth", "host_raw", "v4", "v6host", "path3"))


def test_gzip_import_with_rebalance_equals_plain(spark):
    import gzip

    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    lines = [make_line(ts=f"15/Feb/2026:{h:02d}:00:00 +0000", url=f"http://h{h % 3}.example.com/p{h}") for h in range(24)]
    data = ("\n".join(lines + ["junk"]) + "\n").encode()
    os.makedirs(f"{root}/gz")
    with gzip.open(f"{root}/gz/a.log.gz", "wb") as f:
        f.write(data)
    plain = import_logs(spark, f"{root}/gz/*.gz", f"{root}/t1")
    spread = import_logs(spark, f"{root}/gz/*.gz", f"{root}/t2", rebalance_partitions=4)
    assert plain == spread and plain["lines"] == 25 and plain["accepted"] == 24
    a = sorted(map(tuple, load_requests(spark, f"{root}/t1").collect()))
    b = sorted(map(tuple, load_requests(spark, f"{root}/t2").collect()))
    assert a == b and len(a) == 24


def test_catalog_table_lists_only_matching_days(spark):
    from proxyscope.sources.table import register_requests_table

    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    lines = [make_line(ts=f"{d}/Feb/2026:10:00:00 +0000", url=f"http://h{d % 3}.example.com/p") for d in range(10, 20)]
    _write_logs(f"{root}/logs", {"a.log": ("\n".join(lines) + "\n").encode()})
    import_logs(spark, f"{root}/logs/*.log", f"{root}/requests")
    table = register_requests_table(spark, "proxyscope_test_requests", f"{root}/requests")
    assert table.count() == 10
    bounded = R.top_hosts(table, "2026-02-12 00:00:00", "2026-02-13 23:59:59")
    by_path = R.top_hosts(load_requests(spark, f"{root}/requests"), "2026-02-12 00:00:00", "2026-02-13 23:59:59")
    assert bounded.collect() == by_path.collect()
    assert "InMemoryFileIndex(2 paths)" in _plan(bounded)

    # A later import adds days; registering again records them.
    _write_logs(f"{root}/logs2", {"b.log": (make_line(ts="25/Feb/2026:10:00:00 +0000") + "\n").encode()})
    import_logs(spark, f"{root}/logs2/*.log", f"{root}/requests")
    table = register_requests_table(spark, "proxyscope_test_requests", f"{root}/requests")
    assert table.count() == 11
    assert spark.sql("SHOW PARTITIONS proxyscope_test_requests").count() == 11
    spark.sql("DROP TABLE proxyscope_test_requests")
    assert os.path.isdir(f"{root}/requests")


def test_rebalance_writes_few_files_of_one_time_range_each(spark, tmp_path):
    """20 days in 16 ranges: at most one file per range and day boundary, none overlapping."""
    import glob

    lines = [make_line(ts=f"{d:02d}/Feb/2026:{h:02d}:{m:02d}:00 +0000") for d in range(1, 21) for h in range(24) for m in (0, 20, 40)]
    _write_logs(f"{tmp_path}/logs", {"a.log": ("\n".join(lines[::-1]) + "\n").encode()})
    import_logs(spark, f"{tmp_path}/logs/*.log", f"{tmp_path}/t", rebalance_partitions=16)
    files = glob.glob(f"{tmp_path}/t/dt=*/*.parquet")
    assert len(files) <= 36
    spans = sorted((spark.read.parquet(f).agg({"ts": "min"}).first()[0], spark.read.parquet(f).agg({"ts": "max"}).first()[0]) for f in files[:12])
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert load_requests(spark, f"{tmp_path}/t").count() == len(lines)


def test_directory_import_reports_a_broken_file(spark, tmp_path):
    import gzip

    from proxyscope.sources.table import import_directory

    logs = f"{tmp_path}/logs"
    many = "\n".join(make_line(url=f"http://h{i}.example/{i * 7919}") for i in range(3000)) + "\n"
    _write_logs(logs, {"a.log": (make_line() + "\njunk\n").encode(), "notes.txt": b"not a log\n", "bad.log.gz": gzip.compress(many.encode())[:-2000]})
    with gzip.open(f"{logs}/good.log.gz", "wb") as f:
        f.write((make_line() + "\n").encode())
    out = import_directory(spark, logs, f"{tmp_path}/t")
    assert [os.path.basename(f) for f in out["failed"]] == ["bad.log.gz"]
    assert {os.path.basename(f["file"]): (f["lines"], f["accepted"], f["rejected"]) for f in out["files"]} == {"a.log": (2, 1, 1), "good.log.gz": (1, 1, 0)}
    assert (out["lines"], out["accepted"], out["no_match"]) == (3, 2, 1)
    assert load_requests(spark, f"{tmp_path}/t").count() == 2
    assert import_directory(spark, logs, f"{tmp_path}/t2", pattern="*.none")["files"] == []


def test_storage_round_trip_keeps_all_columns(spark, tmp_path):
    from proxyscope.plans.registry import log_lines
    from proxyscope.schema import REQUESTS_COLUMNS

    lines = log_lines(spark, "/root/testdata/sf0.001")
    lines.write.text(f"{tmp_path}/logs")
    totals = import_logs(spark, f"{tmp_path}/logs/*.txt", f"{tmp_path}/t")
    stored = load_requests(spark, f"{tmp_path}/t").select(*REQUESTS_COLUMNS)
    parsed = parse_lines(lines)
    assert totals["accepted"] == stored.count() == parsed.count()
    assert stored.exceptAll(parsed).count() == 0 and parsed.exceptAll(stored).count() == 0
