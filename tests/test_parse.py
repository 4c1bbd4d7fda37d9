"""Line parsing: fields, reject rules and their order."""

import datetime as dt

from conftest import lines_df, make_line

from proxyscope.operators.parse import classify_lines, import_totals, parse_lines, rejects_by_reason
from proxyscope.schema import REQUESTS_SCHEMA


def _one(spark, line):
    rows = classify_lines(lines_df(spark, [line])).collect()
    assert len(rows) == 1
    return rows[0]


def test_typical_line(spark):
    r = _one(spark, make_line())
    assert r.reason is None
    assert r.ts == dt.datetime(2026, 2, 15, 9, 30, 5)
    assert r.remote_addr == "10.20.30.40"
    assert r.identd is None
    assert r.user_or_session == "reader-17"
    assert r.method == "GET"
    assert r.url == "https://www.example.org:443/books/7?page=2"
    assert (r.scheme, r.host, r.port, r.path, r.query) == ("https", "www.example.org", None, "/books/7", "page=2")
    assert r.http_version == "HTTP/1.1"
    assert r.status == 200
    assert r.bytes == 40960
    assert r.country == "US"
    assert r.user_agent == "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36"
    assert r.raw == make_line()


def test_schema(spark):
    df = parse_lines(lines_df(spark, [make_line()]))
    assert [(f.name, f.dataType) for f in df.schema.fields] == [
        (f.name, f.dataType) for f in REQUESTS_SCHEMA.fields
    ]


def test_dash_fields_and_kept_dash(spark):
    r = _one(spark, make_line(user="-", country="-", ua="-"))
    assert r.user_or_session is None
    assert r.country == "-" and r.user_agent == "-"


def test_space_in_url_moves_into_version(spark):
    r = _one(spark, make_line(url="http://sp/a b"))
    assert r.reason is None
    assert r.url == "http://sp/a" and r.http_version == "b HTTP/1.1"


def test_quote_in_url_is_legal(spark):
    r = _one(spark, make_line(url='http://a/"x'))
    assert r.reason is None and r.url == 'http://a/"x' and r.path == "/%22x"


def test_quote_in_user_agent_rejects(spark):
    assert _one(spark, make_line(ua='Moz"illa')).reason == "no_match"


def test_whitespace_trimmed_and_empty_is_null(spark):
    r = _one(spark, make_line(country="\tUS ", ua="   ") + "  \t")
    assert r.reason is None
    assert r.country == "US" and r.user_agent is None


def test_empty_line_and_truncated(spark):
    assert _one(spark, "").reason == "no_match"
    assert _one(spark, "truncated line 97").reason == "no_match"


def test_lone_cr_inside_is_data(spark):
    r = _one(spark, make_line(ua="Mozilla\rX"))
    assert r.reason is None and r.user_agent == "Mozilla\rX"


def test_timestamps(spark):
    cases = {
        "5/Feb/2026:00:00:04 +0000": dt.datetime(2026, 2, 5, 0, 0, 4),
        "15/FEB/2026:00:00:04 +0000": dt.datetime(2026, 2, 15, 0, 0, 4),
        "15/Feb/2026:00:00:04 -0530": dt.datetime(2026, 2, 15, 5, 30, 4),
        "15/Feb/2026:00:00:04 +00:00": dt.datetime(2026, 2, 15, 0, 0, 4),
        "31/Feb/2026:00:00:04 +0000": None,
        "15/Feb/2026:00:00:60 +0000": None,
        "15/Feb/2026:23:59:60 +0000": None,  # a leap second has no instant that a table could store
        "15/Feb/26:00:00:04 +0000": None,
    }
    rows = classify_lines(lines_df(spark, [make_line(ts=t) for t in cases])).collect()
    for (text, want), r in zip(cases.items(), rows):
        assert r.ts == want, text
        assert r.reason == (None if want else "bad_timestamp"), text


def test_bytes(spark):
    cases = {"-": (None, None), "+5": (5, None), "-5": (-5, None), "1.5": (None, "bad_bytes"),
             "abc": (None, "bad_bytes"), "9223372036854775808": (None, "bad_bytes"),
             "9223372036854775807": (9223372036854775807, None)}
    rows = classify_lines(lines_df(spark, [make_line(nbytes=b) for b in cases])).collect()
    for (text, (value, reason)), r in zip(cases.items(), rows):
        assert (r.bytes, r.reason) == (value, reason), text


def test_status_non_ascii_digits_rejected(spark):
    r = _one(spark, make_line(status="٢٠٠"))  # Arabic-Indic digits match \d
    assert r.reason == "bad_status"


def test_reject_order(spark):
    # bad timestamp wins over bad bytes
    assert _one(spark, make_line(ts="31/Feb/2026:00:00:04 +0000", nbytes="abc")).reason == "bad_timestamp"


def test_totals_and_reasons(spark):
    lines = [make_line(), make_line(nbytes="x"), "garbage", make_line(ts="1/Foo/2026:0:0:0 +0000")]
    df = lines_df(spark, lines)
    t = import_totals(df).first()
    assert (t.lines, t.accepted, t.rejected) == (4, 1, 3)
    got = {r.reason: r.n for r in rejects_by_reason(df).collect()}
    assert got == {"bad_bytes": 1, "no_match": 1, "bad_timestamp": 1}


def test_line_with_lf_takes_exact_path(spark):
    line = make_line(ua="a\nb")
    r = _one(spark, line)
    assert r.reason is None and r.user_agent == "a\nb"


def test_statuses_101_and_600(spark):
    rows = parse_lines(lines_df(spark, [make_line(status="101"), make_line(status="600")])).collect()
    assert sorted(r.status for r in rows) == [101, 600]


def test_line_pattern_groups_match_the_greedy_pattern(spark):
    """The linear Java form gives the same groups as the reference's pattern (Python's backtracking engine)."""
    import random
    import re

    from pyspark.sql import functions as F

    from proxyscope.functions.fields import LINE_PATTERN, with_line_groups

    greedy = re.compile(LINE_PATTERN[:-1] + r"\Z")
    pieces = [" ", "  ", "\t", " ", "　", '"', "[", "]", "a", "GET", "/x", "HTTP/1.1", "200", "2000", "12",
              "-", "٣٤٥", "é", "15/Feb/2026:00:00:04 +0000"]
    base = ['1.2.3.4', ' ', '-', ' ', 'u', ' ', '[', '15/Feb/2026:00:00:04 +0000', ']', ' ', '"', 'GET', ' ', '/x', ' ',
            'HTTP/1.1', '"', ' ', '200', ' ', '12', ' ', '"', 'US', '"', ' ', '"', 'UA', '"']
    rnd = random.Random(5)
    lines = []
    for _ in range(1500):
        parts = list(base)
        for _ in range(rnd.randint(1, 4)):
            k = rnd.randrange(len(parts))
            if rnd.random() < 0.5:
                parts[k] = rnd.choice(pieces)
            else:
                parts.insert(k, rnd.choice(pieces))
        lines.append("".join(parts))
    lines += ['1 - u [t] "GET /x  " 200 1 "" ""', '1 - u [t] "GET /x " 200 1 "" ""', '1 - u [t] "GET /x \t 　" 200 1 "a" "b"']
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    got = {r.value: (tuple(r.g) if r.g is not None else None)
           for r in with_line_groups(df, "value", "g").select("value", F.col("g")).collect()}
    for line in lines:
        m = greedy.match(line)
        assert got[line] == (m.groups() if m else None), line


def test_hostile_lines_stay_linear(spark):
    import time

    from proxyscope.functions.fields import with_line_groups

    ts = "[15/Feb/2026:00:00:04 +0000]"
    long_ws = f'1 - u {ts} "GET /x' + " " * 300000 + 'v" 2000 1 "" ""'
    long_ua = f'1 - u {ts} "GET /x HTTP/1.1" 200 1 "" " a' + " " * 300000 + 'b "'
    df = spark.createDataFrame([(long_ws,), (long_ua,)], "value string")
    t0 = time.time()
    rows = classify_lines(df).select("reason", "user_agent").collect()
    assert time.time() - t0 < 60
    assert rows[0].reason == "no_match" and rows[1].reason is None and rows[1].user_agent.startswith("a ")
