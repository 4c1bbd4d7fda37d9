import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from proxyscope.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[2]", app="proxyscope-tests", shuffle_partitions=2)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    yield s
    s.stop()


def make_line(
    url="https://www.example.org:443/books/7?page=2",
    ts="15/Feb/2026:09:30:05 +0000",
    status="200",
    nbytes="40960",
    country="US",
    ua="Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36",
    method="GET",
    version="HTTP/1.1",
    user="reader-17",
    ip="10.20.30.40",
):
    return f'{ip} - {user} [{ts}] "{method} {url} {version}" {status} {nbytes} "{country}" "{ua}"'


def lines_df(spark, lines):
    return spark.createDataFrame([(v,) for v in lines], "value string")
