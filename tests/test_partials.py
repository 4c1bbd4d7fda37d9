"""Hourly partials, two-pass top keys, rejects in the writing pass, compaction and host lookups."""

import os
import random
import tempfile

import pytest
from conftest import make_line
from pyspark.sql import functions as F

from proxyscope.operators import heavy_keys as H
from proxyscope.operators import partials as M
from proxyscope.operators import reports as R
from proxyscope.operators import rollups as D
from proxyscope.sources import partials as T
from proxyscope.sources import table as S

AGENTS = ["Mozilla Chrome/1", "Firefox", "Safari", "Edg Chrome", "bot", "-", " "]


def _lines(seed, days=3, n=400):
    rng = random.Random(seed)
    out = ["junk", ""]
    for _ in range(n):
        ts = f"{rng.randint(15, 14 + days)}/Feb/2026:{rng.randint(0, 23):02d}:{rng.choice((0, 20, 59)):02d}:{rng.choice((0, 30, 59)):02d} +0000"
        url = f"http://h{rng.randint(0, 30)}.example.com/p{rng.randint(0, 60)}"
        out.append(make_line(ts=ts, url=url, status=str(rng.choice((200, 200, 304, 404, 500, 700))), nbytes=rng.choice(("-", "0", str(rng.randint(1, 2**45)))), ua=rng.choice(AGENTS)))
    return out


def _write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def stored(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for i in range(2):
        _write(f"{root}/logs{i}", f"a{i}.log", _lines(i))
        S.import_logs(spark, f"{root}/logs{i}", f"{root}/requests", keep_rejects=True)
        assert T.refresh_partials(spark, f"{root}/requests", f"{root}/partials") > 0
    return root


def _frames(spark, root):
    return T.load_partials(spark, f"{root}/partials"), S.load_requests(spark, f"{root}/requests")


BOUNDS = [
    (None, None), ("2026-02-15 07:20:30", None), (None, "2026-02-16 18:59:59.999999"), ("2026-02-15 07:00:00", "2026-02-17 08:00:00"),
    ("2026-02-15 07:20:30", "2026-02-15 07:59:00"), ("2026-02-15 07:59:59", "2026-02-15 08:00:00"), ("2026-02-15 23:30:00", "2026-02-16 00:20:30"),
    ("2026-02-16 09:00:00", "2026-02-16 09:59:59.999999"), ("2026-02-17 00:00:00", "2026-02-15 00:00:00"), ("2030-01-01", None),
]


@pytest.mark.parametrize("bounds", BOUNDS)
def test_partials_equal_the_scan(spark, stored, bounds):
    partials, requests = _frames(spark, stored)
    for name in ("requests_over_time", "bandwidth_over_time", "status_codes", "hourly_heatmap", "user_agents"):
        assert getattr(M, name)(partials, requests, *bounds).collect() == getattr(R, name)(requests, *bounds).collect(), name
    for name in ("status_classes", "weekday_totals"):
        assert getattr(M, name)(partials, requests, *bounds).collect() == getattr(D, name)(requests, *bounds).collect(), name


def _scanned(df, part):
    """Rows that the scans of the paths with ``part`` in them gave."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        if hasattr(node, "plan") and node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if node.getClass().getSimpleName() == "FileSourceScanExec" and part in node.relation().location().rootPaths().mkString():
            found += node.metrics().apply("numOutputRows").value()
    return found


def test_whole_hours_read_no_requests(spark, stored):
    partials, requests = _frames(spark, stored)
    plan = M.status_codes(partials, requests)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "/requests" not in plan
    even = M.status_codes(partials, requests, "2026-02-15 07:00:00", "2026-02-16 07:59:59.999999")
    assert _scanned(even, "/requests") == 0
    cut = M.status_codes(partials, requests, "2026-02-15 07:20:00", "2026-02-16 07:30:00")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts,2026-02-15 07:20:00.0)" in plan
    assert _scanned(cut, "/requests") < requests.count()


def test_refresh_adds_a_file_once(spark, stored):
    partials, requests = _frames(spark, stored)
    assert T.refresh_partials(spark, f"{stored}/requests", f"{stored}/partials") == 0
    assert partials.agg(F.sum("n")).first()[0] == requests.count()


def test_refresh_without_a_table_folder(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    assert T.load_partials(spark, f"{root}/partials").count() == 0


def test_rejects_come_from_the_writing_pass(spark, stored):
    rejects = sorted(map(tuple, S.load_rejects(spark, f"{stored}/requests").collect()))
    assert rejects == [("", "no_match")] * 2 + [("junk", "no_match")] * 2
    assert S.load_requests(spark, f"{stored}/requests").count() == 800
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    _write(f"{root}/logs", "a.log", _lines(0))
    with pytest.raises(ValueError):
        S.import_logs(spark, f"{root}/logs", f"{root}/t", rebalance_partitions=2, keep_rejects=True)
    totals = S.import_logs(spark, f"{root}/logs", f"{root}/t")
    assert totals["rejected"] == 2 and S.load_rejects(spark, f"{root}/t").count() == 0


def test_compaction_keeps_rows_and_other_days(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for i in range(4):
        _write(f"{root}/logs{i}", "a.log", _lines(i))
        S.import_logs(spark, f"{root}/logs{i}", f"{root}/requests", max_records_per_file=20, keep_rejects=True)
        T.refresh_partials(spark, f"{root}/requests", f"{root}/partials")
    before = sorted(map(str, S.load_requests(spark, f"{root}/requests").collect()))
    other = sorted(os.listdir(f"{root}/requests/dt=2026-02-16"))
    S.compact_day(spark, f"{root}/requests", "2026-02-15", 2)
    T.rebuild_partials(spark, f"{root}/requests", f"{root}/partials", "2026-02-15")
    files = [f for f in os.listdir(f"{root}/requests/dt=2026-02-15") if f.endswith(".parquet")]
    assert 1 <= len(files) <= 2
    assert sorted(os.listdir(f"{root}/requests/dt=2026-02-16")) == other
    assert sorted(map(str, S.load_requests(spark, f"{root}/requests").collect())) == before
    assert S.load_rejects(spark, f"{root}/requests").count() == 8
    partials, requests = _frames(spark, root)
    assert T.refresh_partials(spark, f"{root}/requests", f"{root}/partials") == 0
    assert M.requests_over_time(partials, requests).collect() == R.requests_over_time(requests).collect()


def test_host_lookup_skips_row_groups(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    lines = [make_line(ts="15/Feb/2026:01:00:00 +0000", url=f"http://h{i * 7919 % 30000:05d}.example.com/p") for i in range(30_000)]
    for i in range(3):
        _write(f"{root}/logs{i}", "a.log", lines[i::3])
        S.import_logs(spark, f"{root}/logs{i}", f"{root}/requests")
    requests = S.load_requests(spark, f"{root}/requests")
    found = S.host_requests(requests, "h00001.example.com")
    assert found.count() == 1
    assert _scanned(found, "/requests") <= 10_000 < requests.count()  # hosts lie in all files, ranges overlap
    assert _scanned(S.host_requests(requests, "h0000x.example.com"), "/requests") == 0
    S.compact_day(spark, f"{root}/requests", "2026-02-15", 6, cluster_by="host")
    again = S.host_requests(S.load_requests(spark, f"{root}/requests"), "h00001.example.com")
    assert again.count() == 1 and _scanned(again, "/requests") <= 7_500


@pytest.mark.parametrize("kind", ["skewed", "flat", "ties", "few", "none"])
@pytest.mark.parametrize("buckets", [4, 64, 1 << 16])
def test_two_pass_top_is_exact(spark, kind, buckets, monkeypatch):
    rng = random.Random(kind)
    keys = {
        "skewed": [f"/hot{rng.randint(0, 25)}" for _ in range(3000)] + [f"/u{i}" for i in range(4000)],
        "flat": [f"/u{i % 2000}" for i in range(4000)],
        "ties": [f"/t{i % 40}" for i in range(2000)] + [f"/u{i}" for i in range(500)],
        "few": ["/a", "/b", "/b"],
        "none": ["/"],
    }[kind]
    rows = [(k, None if i % 7 == 0 else i * 1000) for i, k in enumerate(keys)] + [(None, 5)] * 50
    df = spark.createDataFrame(rows, "path string, bytes long").withColumn("ts", F.lit("2026-02-15").cast("timestamp")).withColumn("host", F.col("path"))
    monkeypatch.setattr(H, "candidates", lambda d, key, k, _f=H.candidates: _f(d, key, k, buckets=buckets))
    assert H.top_paths(df).collect() == R.top_paths(df).collect()
    assert H.top_hosts(df).collect() == R.top_hosts(df).collect()


def test_candidates_do_not_grow_with_the_keys(spark):
    """Ten times the unique keys, the same hot ones: no more keys are counted exactly."""
    counted = []
    for unique in (20_000, 200_000):
        df = spark.range(unique + 60_000).select(F.when(F.col("id") < 60_000, F.concat(F.lit("/hot"), F.col("id") % 20)).otherwise(F.concat(F.lit("/u"), "id")).alias("path"))
        counted.append(H.candidates(df, "path", 15).select("path").distinct().count())
        assert H.sketch(df, "path").count() <= H.ROWS * H.BUCKETS
    assert counted[0] == counted[1] == 20


def test_directory_import_takes_logs_only(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    for name in ("a.log", "b.log.bak", "c.log.tmp", "d.logx", "e.txt"):
        _write(f"{root}/logs", name, [make_line()])
    import gzip

    with gzip.open(f"{root}/logs/f.log.gz", "wb") as f:
        f.write((make_line() + "\n").encode())
    out = S.import_directory(spark, f"{root}/logs", f"{root}/requests")
    assert sorted(os.path.basename(f["file"]) for f in out["files"]) == ["a.log", "f.log.gz"] and out["accepted"] == 2
