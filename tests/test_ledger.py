"""Each log file once, by directory imports and streams; totals by file in the writing pass."""

import gzip
import os
import tempfile

import pytest
from conftest import make_line
from pyspark.sql import functions as F

from proxyscope.sources import ledger as L
from proxyscope.sources import table as S


def _write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("".join(line + "\n" for line in lines))


def _lines(tag, n, day=15):
    return [make_line(url=f"http://{tag}.example/{i}", ts=f"{day}/Feb/2026:01:00:{i % 60:02d} +0000") for i in range(n)]


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _hosts(spark, root):
    rows = L.load_ledgered(spark, f"{root}/t").groupBy("host").count().collect()
    return {r["host"].split(".")[0]: r["count"] for r in rows}


def test_a_second_import_adds_nothing_and_changes_are_reported(spark, root):
    _write(f"{root}/logs", "a.log", [*_lines("a", 5), "junk"])
    _write(f"{root}/logs", "b c%20d.log", _lines("b", 3, day=16))
    _write(f"{root}/logs", "none.log", [])
    out = L.import_new(spark, f"{root}/logs", f"{root}/t")
    assert (out["lines"], out["accepted"], out["rejected"], out["no_match"]) == (9, 8, 1, 1)
    assert sorted((r["lines"], r["accepted"], r["rejected"]) for r in out["files"]) == [(3, 3, 0), (6, 5, 1)]
    assert out["changed"] == out["failed"] == []
    again = L.import_new(spark, f"{root}/logs", f"{root}/t")
    assert (again["lines"], again["files"]) == (0, []) and _hosts(spark, root) == {"a": 5, "b": 3}
    _write(f"{root}/logs", "a.log", _lines("a", 9))
    _write(f"{root}/logs", "c.log", _lines("c", 2))
    out = L.import_new(spark, f"{root}/logs", f"{root}/t")
    assert [os.path.basename(p) for p in out["changed"]] == ["a.log"] and _hosts(spark, root) == {"a": 5, "b": 3, "c": 2}
    ledger = {os.path.basename(r.path): (r.state, r.lines) for r in L.load_ledger(spark, f"{root}/t").collect()}
    assert ledger == {"a.log": ("done", 6), "b c%20d.log": ("done", 3), "c.log": ("done", 2)}


def test_stream_and_directory_import_share_a_table(spark, root):
    _write(f"{root}/logs", "a.log", _lines("a", 4))
    L.import_new(spark, f"{root}/logs", f"{root}/t")
    _write(f"{root}/logs", "b.log", _lines("b", 3))
    _write(f"{root}/logs", "b.log.tmp", _lines("x", 3))
    L.stream_into(spark, f"{root}/logs", f"{root}/t", "one").awaitTermination()
    assert _hosts(spark, root) == {"a": 4, "b": 3}
    assert L.import_new(spark, f"{root}/logs", f"{root}/t")["lines"] == 0
    _write(f"{root}/logs", "c.log", _lines("c", 2, day=17))
    L.stream_into(spark, f"{root}/logs", f"{root}/t", "one").awaitTermination()
    L.stream_into(spark, f"{root}/logs", f"{root}/t", "two").awaitTermination()  # sees all files anew, takes none
    assert _hosts(spark, root) == {"a": 4, "b": 3, "c": 2}
    table = L.register_ledgered(spark, "ledgered_requests", f"{root}/t")
    assert table.where("dt = date'2026-02-17'").count() == 2 and table.count() == 9
    spark.sql("DROP TABLE ledgered_requests")
    with pytest.raises(ValueError, match="name"):
        L.stream_into(spark, f"{root}/logs", f"{root}/t", "dir")


def test_a_replayed_batch_adds_nothing(spark, root):
    _write(f"{root}/logs", "a.log", [*_lines("a", 4), *_lines("a", 2, day=16)])
    _write(f"{root}/logs", "b.log", _lines("b", 3))
    files = L.listed_files(spark, f"{root}/logs")
    for _ in range(3):
        L.take_batch(files, 7, f"{root}/t", "s")
    assert _hosts(spark, root) == {"a": 6, "b": 3}
    assert L.load_ledger(spark, f"{root}/t").count() == 2
    L.take_batch(files, 8, f"{root}/t", "s")  # another batch finds the files taken
    assert _hosts(spark, root) == {"a": 6, "b": 3}


@pytest.mark.parametrize("after", ["claim", "rows"])
def test_what_a_failed_import_left_is_removed(spark, root, after, monkeypatch):
    _write(f"{root}/logs", "a.log", _lines("a", 4))
    record, calls = L._record, []

    def failing(spark, path, rows):
        calls.append(rows[0][3])
        if rows[0][3] == "done":
            raise RuntimeError("lost")
        record(spark, path, rows)

    monkeypatch.setattr(L, "_record", failing)
    monkeypatch.setattr(L, "_release", lambda *a: None)  # the driver is gone before it can clean up
    if after == "claim":
        monkeypatch.setattr(L, "read_lines", lambda *a, **k: 1 / 0)
    with pytest.raises((RuntimeError, ZeroDivisionError)):
        L.import_new(spark, f"{root}/logs", f"{root}/t")
    monkeypatch.undo()
    _write(f"{root}/logs", "b.log", _lines("b", 1))
    L.import_new(spark, f"{root}/logs", f"{root}/t")
    assert _hosts(spark, root) == {"a": 4, "b": 1}
    assert {r.state for r in L.load_ledger(spark, f"{root}/t").collect()} == {"done"}


def test_a_broken_file_is_left_out_and_tried_again(spark, root):
    _write(f"{root}/logs", "a.log", _lines("a", 4))
    data = gzip.compress("\n".join(f"{v} {i * 7919}" for i, v in enumerate(_lines("z", 3000))).encode())
    with open(f"{root}/logs/z.log.gz", "wb") as f:
        f.write(data[:-2000])
    out = L.import_new(spark, f"{root}/logs", f"{root}/t")
    assert [os.path.basename(p) for p in out["failed"]] == ["z.log.gz"] and _hosts(spark, root) == {"a": 4}
    with gzip.open(f"{root}/logs/z.log.gz", "wb") as f:
        f.write("\n".join(_lines("z", 2)).encode())
    assert L.import_new(spark, f"{root}/logs", f"{root}/t")["accepted"] == 2 and _hosts(spark, root) == {"a": 4, "z": 2}


def test_totals_by_file_come_from_the_writing_pass(spark, root, monkeypatch):
    for i in range(40):
        _write(f"{root}/logs", f"f{i:02d}.log", [*_lines("a", i), *["junk"] * (i % 3)])
    monkeypatch.setattr(S, "file_totals", lambda *a: 1 / 0)
    out = S.import_directory(spark, f"{root}/logs", f"{root}/t")
    want = {f"f{i:02d}.log": (i + i % 3, i, i % 3) for i in range(1, 40)}
    assert {os.path.basename(f["file"]): (f["lines"], f["accepted"], f["rejected"]) for f in out["files"]} == want
    monkeypatch.undo()
    monkeypatch.setattr(S, "MOST_FILES", 3)  # beyond the metric's bound: the same by a second pass
    assert S.import_directory(spark, f"{root}/logs", f"{root}/t2")["files"] == out["files"]


def test_coverage_reads_footers_and_two_days(spark, root):
    _write(f"{root}/logs", "a.log", [*_lines("a", 5, 15), *_lines("a", 700, 16), *_lines("a", 6, 18), "junk"])
    S.import_logs(spark, f"{root}/logs", f"{root}/t", keep_rejects=True)
    got, want = S.stored_coverage(spark, f"{root}/t"), S.table_coverage(S.load_requests(spark, f"{root}/t"))
    assert got.collect() == want.collect() and got.schema == want.schema
    meta = spark.newSession()
    meta.conf.set("spark.sql.sources.useV1SourceList", "")
    meta.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    plan = S.rows_by_day(meta, f"{root}/t")._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "ReadSchema: struct<dt:date,count(*):bigint>" in plan
    assert got.where(F.lit(True))._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
