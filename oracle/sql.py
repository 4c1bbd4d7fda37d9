"""DuckDB SQL that recomputes every registered query from the base tables.

Written independently of the Spark code, in DuckDB's own dialect and regex
engine (RE2): it generates the same log lines from ``events`` and ``pages``,
parses them, splits URLs with plain regular expressions (enough for the URLs
in the generated logs) and runs each report. The views ``events`` and
``pages`` are expected to exist. Times stay plain TIMESTAMP in UTC so the
result does not depend on DuckDB's time zone setting.
"""

from __future__ import annotations

from proxyscope.plans.registry import FROM_START, MID_HOURS, NO_DATA, ONE_HOUR, RANGE_END, RANGE_START, UNTIL_END


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_UA = (
    "CASE u % 9 WHEN 0 THEN 'Mozilla/5.0 AppleWebKit/537.36 Chrome/120.0 Safari/537.36' "
    "WHEN 1 THEN 'Mozilla/5.0 Chrome/120.0 Safari/537.36 Edg/120.0' "
    "WHEN 2 THEN 'Mozilla/5.0 Gecko/20100101 Firefox/121.0' "
    "WHEN 3 THEN 'Mozilla/5.0 Version/17.2 Safari/605.1.15' "
    "WHEN 4 THEN 'Opera/9.80 Presto/2.12' "
    "WHEN 5 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' "
    "WHEN 6 THEN 'curl/8.4.0' WHEN 7 THEN '-' ELSE '' END"
)

# The line, written here on its own: three fields, a bracketed time, the quoted request
# (method, target, version), status, bytes, and two quoted fields, all apart by white space.
# A status is three digits of any script.
_FIELD, _GAP, _QUOTED = r"(\S+)", r"\s+", r'"([^"]*)"'
_PIECES = [
    *[_FIELD] * 3, r"\[([^\]]+)\]", r'"' + _FIELD + _GAP + _FIELD + _GAP + r'([^"]+)"',
    r"(\p{Nd}{3})", _FIELD, *[_QUOTED] * 2,
]
_RE = _lit("^" + _GAP.join(_PIECES) + r"\s*$")

BASE = f"""
WITH np AS (SELECT count(*) AS n_pages FROM pages),
ev AS (
  SELECT e.event_id AS id, e.ts, e.user_id AS u, e.event_type AS kind, e.value, p.url AS page_url
  FROM events e CROSS JOIN np JOIN pages p ON p.page_id = e.event_id % np.n_pages
),
lines AS (
  SELECT CASE WHEN id % 97 = 0 THEN 'truncated line ' || CAST(id AS VARCHAR) ELSE
    '10.0.' || CAST(u % 4 AS VARCHAR) || '.' || CAST(u % 250 AS VARCHAR) || ' - '
    || CASE WHEN u % 10 = 0 THEN '-' ELSE 'u' || CAST(u AS VARCHAR) END
    || ' [' || CASE WHEN id % 83 = 0 THEN '31/Feb/2024:00:00:00 +0000'
                    WHEN id % 31 = 0 THEN strftime(ts + INTERVAL 330 MINUTE, '%d/%b/%Y:%H:%M:%S') || ' +0530'
                    WHEN id % 37 = 0 THEN strftime(ts - INTERVAL 480 MINUTE, '%d/%b/%Y:%H:%M:%S') || ' -0800'
                    ELSE strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' END || '] "'
    || CASE WHEN id % 13 = 0 THEN 'CONNECT' WHEN kind = 'purchase' THEN 'POST' ELSE 'GET' END || ' '
    || CASE WHEN id % 13 = 0 THEN 'www.example.org:443'
            WHEN id % 11 = 0 THEN '/login?url=' || page_url
            WHEN id % 19 = 0 THEN 'https://Root.Example.org'
            WHEN id % 17 = 0 THEN replace(page_url, '/en/', ':8080/en/')
            WHEN id % 7 = 0 THEN replace(replace(page_url, 'http:', 'https:'), '/en/', ':443/en/')
            WHEN id % 5 = 1 THEN replace(page_url, '.example.', '.EXAMPLE.')
            ELSE page_url END
    || ' HTTP/1.1" '
    || CASE WHEN id % 103 = 0 THEN '４０４' ELSE CAST(CASE WHEN id % 101 = 0 THEN 101
                 WHEN kind = 'error' AND id % 3 = 0 THEN 500
                 WHEN kind = 'error' AND id % 3 = 1 THEN 404
                 WHEN kind = 'error' THEN 403
                 WHEN kind = 'click' AND id % 4 = 0 THEN 302
                 WHEN kind = 'signup' THEN 304
                 WHEN kind = 'purchase' THEN 201 ELSE 200 END AS VARCHAR) END || ' '
    || CASE WHEN id % 89 = 0 THEN 'abc' WHEN id % 9 = 0 THEN '-'
            ELSE CASE WHEN id % 41 = 0 THEN '+' WHEN id % 43 = 0 THEN '-' ELSE '' END
                 || CAST(CAST(floor(value * 10000) AS BIGINT) AS VARCHAR) END
    || ' "' || CASE WHEN id % 23 = 0 THEN '' WHEN id % 29 = 0 THEN ' TR '
                    ELSE chr(CAST(65 + u % 25 AS INTEGER)) || chr(CAST(65 + (u * 7) % 26 AS INTEGER)) END
    || '" "' || {_UA} || '"'
  END AS raw
  FROM ev
),
x AS (
  SELECT raw, regexp_matches(raw, {_RE}) AS m,
    regexp_extract(raw, {_RE}, ['g1', 'g2', 'g3', 'g4', 'g5', 'g6', 'g7', 'g8', 'g9', 'g10', 'g11']) AS gs
  FROM lines
),
g AS (
  SELECT raw, m, gs.g1, gs.g2, gs.g3, gs.g4, gs.g5, gs.g6, gs.g7, gs.g8, gs.g9, gs.g10, gs.g11 FROM x
),
t AS (
  SELECT *,
    try_strptime(split_part(g4, ' ', 1), '%d/%b/%Y:%H:%M:%S')
      - to_minutes(CAST(CASE WHEN substr(g4, -5, 1) = '-' THEN -1 ELSE 1 END
          * (TRY_CAST(substr(g4, -4, 2) AS INTEGER) * 60 + TRY_CAST(substr(g4, -2, 2) AS INTEGER)) AS BIGINT)) AS ts,
    CASE WHEN regexp_full_match(g8, '[0-9]+') THEN CAST(g8 AS INTEGER) END AS status,
    CASE WHEN g9 = '-' THEN NULL ELSE TRY_CAST(regexp_replace(g9, '^[+]', '') AS BIGINT) END AS bytes,
    regexp_extract(g6, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme_raw
  FROM g
),
c AS (
  SELECT *,
    CASE WHEN NOT m THEN 'no_match'
         WHEN ts IS NULL THEN 'bad_timestamp'
         WHEN status IS NULL THEN 'bad_status'
         WHEN g9 <> '-' AND bytes IS NULL THEN 'bad_bytes' END AS reason
  FROM t
),
u1 AS (
  SELECT *,
    lower(scheme_raw) IN ('http', 'https', 'ws', 'wss', 'ftp') AS special,
    regexp_replace(substr(g6, length(scheme_raw) + 2), '^[/\\\\]+', '') AS srest,
    substr(g6, length(scheme_raw) + 2) AS orest
  FROM c WHERE reason IS NULL
),
u2 AS (
  SELECT *, regexp_extract(srest, '^([^/\\\\?#]*)', 1) AS auth FROM u1
),
u3 AS (
  SELECT *,
    regexp_extract(auth, '([^@]*)$', 1) AS hostport,
    substr(srest, length(auth) + 1) AS stail
  FROM u2
),
u4 AS (
  SELECT *,
    lower(regexp_extract(hostport, '^([^:]*)', 1)) AS s_host,
    TRY_CAST(nullif(regexp_extract(hostport, ':([0-9]*)$', 1), '') AS INTEGER) AS s_port,
    regexp_extract(stail, '^([^?#]*)', 1) AS s_path,
    CASE WHEN regexp_matches(stail, '^[^#]*[?]') THEN regexp_extract(stail, '^[^?#]*[?]([^#]*)', 1) END AS s_query,
    regexp_extract(orest, '^([^?#]*)', 1) AS o_path,
    CASE WHEN regexp_matches(orest, '^[^#]*[?]') THEN regexp_extract(orest, '^[^?#]*[?]([^#]*)', 1) END AS o_query
  FROM u3
),
requests AS (
  SELECT
    ts,
    g1 AS remote_addr,
    nullif(g2, '-') AS identd,
    nullif(g3, '-') AS user_or_session,
    g5 AS method,
    g6 AS url,
    CASE WHEN scheme_raw <> '' THEN lower(scheme_raw) END AS scheme,
    CASE WHEN special THEN s_host END AS host,
    CAST(CASE WHEN special AND s_port <> CASE lower(scheme_raw) WHEN 'http' THEN 80 WHEN 'https' THEN 443
              WHEN 'ws' THEN 80 WHEN 'wss' THEN 443 WHEN 'ftp' THEN 21 END THEN s_port END AS INTEGER) AS port,
    CASE WHEN special THEN CASE WHEN s_path = '' THEN '/' ELSE s_path END
         WHEN scheme_raw <> '' THEN o_path END AS path,
    CASE WHEN special THEN s_query WHEN scheme_raw <> '' THEN o_query END AS query,
    g7 AS http_version,
    status,
    bytes,
    nullif(regexp_replace(g10, '^\\s+|\\s+$', '', 'g'), '') AS country,
    nullif(regexp_replace(g11, '^\\s+|\\s+$', '', 'g'), '') AS user_agent,
    raw
  FROM u4
)
"""

_HOUR = "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') || '+00'"


def _where(start: str | None, end: str | None, extra: str | None = None) -> str:
    conds = []
    if extra:
        conds.append(extra)
    if start:
        conds.append(f"ts >= TIMESTAMP {_lit(start)}")
    if end:
        conds.append(f"ts <= TIMESTAMP {_lit(end)}")
    return ("WHERE " + " AND ".join(conds)) if conds else ""


def requests_over_time(start=None, end=None, limit="") -> str:
    return (
        f"SELECT {_HOUR} AS t, count(*) AS n FROM requests {_where(start, end)} "
        f"GROUP BY date_trunc('hour', ts) ORDER BY date_trunc('hour', ts) {limit}"
    )


def top_hosts(start=None, end=None) -> str:
    return (
        f"SELECT host, count(*) AS n FROM requests {_where(start, end, 'host IS NOT NULL')} "
        "GROUP BY host ORDER BY n DESC, host ASC NULLS LAST LIMIT 15"
    )


def status_codes(start=None, end=None) -> str:
    return (
        f"SELECT status, count(*) AS n FROM requests {_where(start, end)} "
        "GROUP BY status ORDER BY n DESC, status ASC NULLS LAST"
    )


def top_countries(start=None, end=None, limit=20) -> str:
    return (
        "SELECT country, count(*) AS n FROM requests "
        f"{_where(start, end, 'country IS NOT NULL AND country <> ' + _lit(''))} "
        f"GROUP BY country ORDER BY n DESC, country ASC NULLS LAST LIMIT {limit}"
    )


def bandwidth_over_time(start=None, end=None, limit="") -> str:
    # mebibytes of the hour's total; the cast rounds a tie to the even neighbour
    return (
        f"SELECT strftime(h, '%Y-%m-%d %H:%M:%S') || '+00' AS t, CAST(total / {float(1 << 20)} AS BIGINT) AS mb FROM "
        "(SELECT date_trunc('hour', ts) AS h, coalesce(sum(bytes), 0) AS total "
        f"FROM requests {_where(start, end)} GROUP BY h) ORDER BY h {limit}"
    )


def hourly_heatmap(start=None, end=None) -> str:
    return (
        "SELECT CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) AS INTEGER) AS day, count(*) AS n "
        f"FROM requests {_where(start, end)} GROUP BY 1, 2 ORDER BY 1, 2"
    )


def error_analysis(start=None, end=None) -> str:
    # errors are statuses from 400; those from 500 are the server's, the rest the client's
    return (
        "SELECT host, server + client AS errors, server AS server_errors, client AS client_errors FROM "
        "(SELECT host, count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS client, "
        f"count(*) FILTER (WHERE status > 499) AS server FROM requests {_where(start, end)} GROUP BY host) "
        "WHERE server + client > 0 ORDER BY errors DESC, host ASC NULLS LAST LIMIT 10"
    )


def top_paths(start=None, end=None) -> str:
    return (
        "SELECT path, count(*) AS n, CAST(trunc(AVG(COALESCE(bytes, 0)) / 1024.0) AS BIGINT) AS avg_kb "
        f"FROM requests {_where(start, end, 'path IS NOT NULL AND path <> ' + _lit('/'))} "
        "GROUP BY path ORDER BY n DESC, path ASC NULLS LAST LIMIT 15"
    )


# Browser families in order of precedence: name, marks of which one must occur,
# mark that must not. Matching is case-sensitive; what matches none is "Other".
FAMILIES = [
    ("Chrome", ["Chrome"], "Edg"), ("Firefox", ["Firefox"], None), ("Safari", ["Safari"], "Chrome"),
    ("Edge", ["Edg"], None), ("Opera", ["Opera"], None), ("Bot", ["bot", "Bot"], None),
]


def user_agents(start=None, end=None) -> str:
    values = ", ".join(f"({i}, {_lit(name)}, {marks!r}, {_lit(no or '')})" for i, (name, marks, no) in enumerate(FAMILIES))
    return (
        "SELECT coalesce(family, 'Other') AS browser, CAST(sum(n) AS BIGINT) AS n FROM "
        "(SELECT a.user_agent, any_value(a.n) AS n, arg_min(f.family, f.pos) AS family FROM "
        f"(SELECT user_agent, count(*) AS n FROM requests {_where(start, end, 'user_agent IS NOT NULL')} GROUP BY user_agent) a "
        f"LEFT JOIN (VALUES {values}) f(pos, family, marks, no) "
        "ON len(list_filter(f.marks, lambda m: contains(a.user_agent, m))) > 0 "
        "AND NOT (f.no <> '' AND contains(a.user_agent, f.no)) GROUP BY a.user_agent) "
        "GROUP BY browser ORDER BY n DESC, browser ASC NULLS LAST"
    )


def status_classes(start=None, end=None) -> str:
    return (
        "SELECT k.class, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM "
        "(VALUES ('2xx', 1), ('3xx', 2), ('4xx', 3), ('5xx', 4), ('Other', 5)) k(class, pos) LEFT JOIN "
        "(SELECT CASE WHEN floor(status / 100.0) BETWEEN 2 AND 5 "
        "THEN CAST(CAST(floor(status / 100.0) AS INTEGER) AS VARCHAR) || 'xx' ELSE 'Other' END AS class, "
        f"count(*) AS n FROM requests {_where(start, end)} GROUP BY 1) c USING (class) ORDER BY k.pos"
    )


def weekday_totals(start=None, end=None) -> str:
    return (
        "SELECT CAST(k.day AS INTEGER) AS day, k.name, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM "
        "(VALUES (0, 'Sun'), (1, 'Mon'), (2, 'Tue'), (3, 'Wed'), (4, 'Thu'), (5, 'Fri'), (6, 'Sat')) k(day, name) "
        "LEFT JOIN (SELECT dayofweek(ts) AS day, count(*) AS n "
        f"FROM requests {_where(start, end)} GROUP BY 1) c USING (day) ORDER BY k.day"
    )


_PARSE_ONLY = {
    "parse_requests": (
        "SELECT ts, remote_addr, identd, user_or_session, method, url, scheme, host, port, path, query, "
        "http_version, status, bytes, country, user_agent, raw FROM requests"
    ),
    "rejected_lines": "SELECT raw, reason FROM c WHERE reason IS NOT NULL",
    "rejects_by_reason": "SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY reason",
    "import_totals": (
        "SELECT count(*) AS lines, count(*) FILTER (WHERE reason IS NULL) AS accepted, "
        "count(*) FILTER (WHERE reason IS NOT NULL) AS rejected FROM c"
    ),
    "table_coverage": "SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM requests",
    "url_parts": (
        "SELECT url, scheme, host, port, path, query, count(*) AS n FROM requests "
        "GROUP BY url, scheme, host, port, path, query"
    ),
}

_REPORTS = {
    "requests_over_time": requests_over_time(),
    "requests_over_time_first_200": requests_over_time(limit="LIMIT 200"),
    "bandwidth_over_time_first_200": bandwidth_over_time(limit="LIMIT 200"),
    "bandwidth_over_time_until": bandwidth_over_time(None, UNTIL_END),
    "requests_over_time_range_dt": requests_over_time(RANGE_START, RANGE_END),
    "top_hosts_range_dt": top_hosts(RANGE_START, RANGE_END),
    "status_codes_until_dt": status_codes(None, UNTIL_END),
    "requests_by_day": "SELECT CAST(ts AS DATE) AS dt, count(*) AS n FROM requests GROUP BY 1",
    "top_hosts_from": top_hosts(FROM_START, None),
    "top_hosts_until": top_hosts(None, UNTIL_END),
    "status_codes_from": status_codes(FROM_START, None),
    "status_codes_until": status_codes(None, UNTIL_END),
    "top_countries_from": top_countries(FROM_START, None),
    "top_countries_until": top_countries(None, UNTIL_END),
    "top_hosts_no_data": top_hosts(NO_DATA, None),
    "requests_over_time_range": requests_over_time(RANGE_START, RANGE_END),
    "requests_over_time_from": requests_over_time(FROM_START, None),
    "requests_over_time_until": requests_over_time(None, UNTIL_END),
    "top_hosts": top_hosts(),
    "top_hosts_range": top_hosts(RANGE_START, RANGE_END),
    "status_codes": status_codes(),
    "status_codes_range": status_codes(RANGE_START, RANGE_END),
    "top_countries": top_countries(),
    "top_countries_range": top_countries(RANGE_START, RANGE_END),
    "top_countries_10": top_countries(limit=10),
    "bandwidth_over_time": bandwidth_over_time(),
    "bandwidth_over_time_range": bandwidth_over_time(RANGE_START, RANGE_END),
    "bandwidth_over_time_from": bandwidth_over_time(FROM_START, None),
    "hourly_heatmap": hourly_heatmap(),
    "hourly_heatmap_range": hourly_heatmap(RANGE_START, RANGE_END),
    "error_analysis": error_analysis(),
    "error_analysis_range": error_analysis(RANGE_START, RANGE_END),
    "top_paths": top_paths(),
    "top_paths_range": top_paths(RANGE_START, RANGE_END),
    "user_agents": user_agents(),
    "user_agents_range": user_agents(RANGE_START, RANGE_END),
    "status_classes": status_classes(),
    "status_classes_range": status_classes(RANGE_START, RANGE_END),
    "weekday_totals": weekday_totals(),
    "weekday_totals_range": weekday_totals(RANGE_START, RANGE_END),
    "stored_top_countries_range": top_countries(RANGE_START, RANGE_END),
    "stored_host": "SELECT host, CAST(ts AS DATE) AS dt, status, count(*) AS n FROM requests WHERE host = (SELECT min(host) FROM requests) GROUP BY ALL",
    "partials_requests_over_time": requests_over_time(),
    "partials_requests_over_time_mid": requests_over_time(*MID_HOURS),
    "partials_requests_over_time_hour": requests_over_time(*ONE_HOUR),
    "partials_bandwidth_over_time_mid": bandwidth_over_time(*MID_HOURS),
    "partials_status_codes_mid": status_codes(*MID_HOURS),
    "partials_status_codes_from": status_codes(FROM_START, None),
    "partials_hourly_heatmap_until": hourly_heatmap(None, UNTIL_END),
    "partials_user_agents_mid": user_agents(*MID_HOURS),
    "partials_status_classes_mid": status_classes(*MID_HOURS),
    "partials_weekday_totals_range": weekday_totals(RANGE_START, RANGE_END),
    "partials_weekday_totals_no_data": weekday_totals(NO_DATA, None),
    "two_pass_top_hosts": top_hosts(),
    "two_pass_top_paths": top_paths(),
    "two_pass_top_paths_range": top_paths(RANGE_START, RANGE_END),
}


# URLs in other forms: for each, the text and what the URL Standard makes of it.
_GENERAL_FORMS = [
    ("'http://h' || n || '.example/a/b/../c?x=' || n", "'http'", "'h' || n || '.example'", "NULL", "'/a/c'", "'x=' || n"),
    ("'http://h' || n || '.example/a/./b/%2e%2E/'", "'http'", "'h' || n || '.example'", "NULL", "'/a/'", "NULL"),
    ("'http://0x7f.0.0.' || (id % 256) || '/p'", "'http'", "'127.0.0.' || (id % 256)", "NULL", "'/p'", "NULL"),
    ("'http://[0:0:0::' || (id % 9 + 1) || ']:8080/x'", "'http'", "'[::' || (id % 9 + 1) || ']'", "8080", "'/x'", "NULL"),
    ("'https://user:pw@H' || n || '.Example:443/s'", "'https'", "'h' || n || '.example'", "NULL", "'/s'", "NULL"),
    (r"'http:\\h' || n || '.example\a\b'", "'http'", "'h' || n || '.example'", "NULL", "'/a/b'", "NULL"),
    ("'http://h' || n || '.example:' || (id + 100000) || '/'", *["NULL"] * 5),
    ("'http://h' || n || '.example/{x}?q=\"' || n || '\"'", "'http'", "'h' || n || '.example'", "NULL", "'/%7Bx%7D'", "'q=%22' || n || '%22'"),
    ("'file:///C|/dir/' || n", "'file'", "NULL", "NULL", "'/C:/dir/' || n", "NULL"),
    ("'urn:isbn:' || n", "'urn'", "NULL", "NULL", "'isbn:' || n", "NULL"),
    ("'foo://Host' || n || ':99/x/../y'", "'foo'", "'Host' || n", "99", "'/y'", "NULL"),
    ("'http://%ff' || n || '.example/'", *["NULL"] * 5),
    ("'http://h' || n || '.example/é?ü'", "'http'", "'h' || n || '.example'", "NULL", "'/%C3%A9'", "'%C3%BC'"),
    ("'http://1.2.3.' || (id + 256) || '/'", *["NULL"] * 5),
]


def url_parts_general() -> str:
    def column(i: int, kind: str, name: str) -> str:
        cases = " ".join(f"WHEN {k} THEN {form[i]}" for k, form in enumerate(_GENERAL_FORMS))
        return f"CAST(CASE id % {len(_GENERAL_FORMS)} {cases} END AS {kind}) AS {name}"

    names = ["url", "scheme", "host", "port", "path", "query"]
    columns = [column(i, "INTEGER" if n == "port" else "VARCHAR", n) for i, n in enumerate(names)]
    return f"SELECT id AS page_id, {', '.join(columns)} FROM (SELECT page_id AS id, CAST(page_id AS VARCHAR) AS n FROM pages)"


def oracle_queries() -> dict[str, str]:
    """name -> complete DuckDB statement."""
    out = {name: BASE + sql for name, sql in {**_PARSE_ONLY, **_REPORTS}.items()}
    for name in ("requests", "rejected_lines", "requests_by_day", "coverage"):  # the table read back holds the same
        out[f"stored_{name}"] = out[{"requests": "parse_requests", "coverage": "table_coverage"}.get(name, name)]
    out["footer_coverage"] = out["table_coverage"]
    out["ledger_requests"], out["ledger_totals"] = out["parse_requests"], out["import_totals"]
    out["url_parts_general"] = url_parts_general()
    out["report_document"] = BASE + report_documents()
    out["report_document_no_data"] = BASE + report_documents((NO_DATA, None))
    return out


# Report documents: each report as {key: [rows...]} JSON text, built by
# DuckDB's JSON functions from the report SQL above.
_DOCS = [
    ("requests_over_time", "series", ["t", "n"], "t"),
    ("top_hosts", "hosts", ["host", "n"], "n DESC, host ASC NULLS LAST"),
    ("status_codes", "status", ["status", "n"], "n DESC, status ASC NULLS LAST"),
    ("top_countries", "countries", ["country", "n"], "n DESC, country ASC NULLS LAST"),
    ("bandwidth_over_time", "series", ["t", "mb"], "t"),
    ("hourly_heatmap", "data", ["hour", "day", "n"], "hour, day"),
    ("error_analysis", "hosts", ["host", "errors", "server_errors", "client_errors"],
     "errors DESC, host ASC NULLS LAST"),
    ("top_paths", "paths", ["path", "n", "avg_kb"], "n DESC, path ASC NULLS LAST"),
    ("user_agents", "browsers", ["browser", "n"], "n DESC, browser ASC NULLS LAST"),
    ("status_classes", "classes", ["class", "n"], "list_position(['2xx', '3xx', '4xx', '5xx', 'Other'], class)"),
    ("weekday_totals", "days", ["day", "name", "n"], "day"),
]


def report_documents(bounds=(None, None)) -> str:
    parts = []
    for name, key, cols, order in _DOCS:
        obj = "json_object(" + ", ".join(f"{_lit(c)}, {c}" for c in cols) + ")"
        inner = globals()[name](*bounds)
        parts.append(
            f"SELECT {_lit(name)} AS report, CAST(json_object({_lit(key)}, "
            f"(SELECT coalesce(to_json(list({obj} ORDER BY {order})), '[]'::JSON) FROM ({inner}) r)) AS VARCHAR) AS doc"
        )
    return " UNION ALL ".join(parts)
