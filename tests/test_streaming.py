"""Incremental import: new files only, exactly once."""

import os
import tempfile

import pytest
from conftest import make_line

from proxyscope.sources.table import load_requests
from proxyscope.streaming.incremental import incremental_import


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_second_run_adds_nothing_and_new_files_are_picked_up(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    src, table, ckpt = f"{root}/logs", f"{root}/requests", f"{root}/ckpt"
    os.makedirs(src)
    _write(f"{src}/a.log", [make_line(ts="15/Feb/2026:01:00:00 +0000"), "junk"])
    _write(f"{src}/b.log", [make_line(ts="16/Feb/2026:01:00:00 +0000")])

    q = incremental_import(spark, src, table, checkpoint_location=ckpt)
    q.awaitTermination()
    assert load_requests(spark, table).count() == 2
    observed = [p["observedMetrics"].get("import_totals") for p in q.recentProgress if p.get("observedMetrics")]
    assert sum(int(m["lines"]) for m in observed if m) == 3

    q = incremental_import(spark, src, table, checkpoint_location=ckpt)
    q.awaitTermination()
    assert load_requests(spark, table).count() == 2

    _write(f"{src}/c.log", [make_line(ts="16/Feb/2026:02:00:00 +0000"), make_line(ts="17/Feb/2026:02:00:00 +0000")])
    q = incremental_import(spark, src, table, checkpoint_location=ckpt)
    q.awaitTermination()
    t = load_requests(spark, table)
    assert t.count() == 4
    assert sorted(str(r.dt) for r in t.select("dt").distinct().collect()) == ["2026-02-15", "2026-02-16", "2026-02-17"]


def test_another_checkpoint_is_refused(spark, tmp_path):
    src, table = f"{tmp_path}/logs", f"{tmp_path}/requests"
    os.makedirs(src)
    _write(f"{src}/a.log", [make_line()])
    _write(f"{src}/notes.txt", [make_line()])
    incremental_import(spark, src, table).awaitTermination()
    assert load_requests(spark, table).count() == 1  # only *.log
    _write(f"{src}/b.log", [make_line()] * 4)
    with pytest.raises(ValueError, match="another checkpoint"):
        incremental_import(spark, src, table, checkpoint_location=f"{tmp_path}/other")
    incremental_import(spark, src, table).awaitTermination()  # the default one belongs to the table
    assert load_requests(spark, table).count() == 5
