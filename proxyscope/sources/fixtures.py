"""Access-log lines derived from the driver tables ``events`` and ``pages``.

There are no sample logs to read, so test and benchmark lines are built by a
Spark job: one line per event, the page chosen by ``event_id % n_pages``. The
rules (first match wins) mix clean traffic with every kind of line the parser
has to reject or normalise: truncated lines, an impossible date, unparsable
byte counts, status digits that are not ASCII, signed byte counts, local time with an
offset, CONNECT targets, relative URLs, default and explicit ports, host
case and padded country fields.

The work grows with ``events``; ``pages`` is joined on its id, broadcast only
when its measured size is under the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxyscope.plans.joins import estimated_bytes, join_small_side

# The user-agent strings of the generated traffic, chosen by
# user_id % 9, in this order.
USER_AGENTS = (
    "Mozilla/5.0 AppleWebKit/537.36 Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 Chrome/120.0 Safari/537.36 Edg/120.0",
    "Mozilla/5.0 Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 Version/17.2 Safari/605.1.15",
    "Opera/9.80 Presto/2.12",
    "Mozilla/5.0 (compatible; Googlebot/2.1)",
    "curl/8.4.0",
    "-",
    "",
)


def _url(id_: Column, page_url: Column) -> Column:
    return (
        F.when(id_ % 13 == 0, F.lit("www.example.org:443"))
        .when(id_ % 11 == 0, F.concat(F.lit("/login?url="), page_url))
        .when(id_ % 19 == 0, F.lit("https://Root.Example.org"))
        .when(id_ % 17 == 0, F.replace(page_url, F.lit("/en/"), F.lit(":8080/en/")))
        .when(
            id_ % 7 == 0,
            F.replace(F.replace(page_url, F.lit("http:"), F.lit("https:")), F.lit("/en/"), F.lit(":443/en/")),
        )
        .when(id_ % 5 == 1, F.replace(page_url, F.lit(".example."), F.lit(".EXAMPLE.")))
        .otherwise(page_url)
    )


def _status(id_: Column, kind: Column) -> Column:
    return (
        F.when(id_ % 101 == 0, F.lit(101))
        .when((kind == "error") & (id_ % 3 == 0), F.lit(500))
        .when((kind == "error") & (id_ % 3 == 1), F.lit(404))
        .when(kind == "error", F.lit(403))
        .when((kind == "click") & (id_ % 4 == 0), F.lit(302))
        .when(kind == "signup", F.lit(304))
        .when(kind == "purchase", F.lit(201))
        .otherwise(F.lit(200))
    )


def _user_agent(u: Column) -> Column:
    expr = F.when(u % 9 == 0, F.lit(USER_AGENTS[0]))
    for i, ua in enumerate(USER_AGENTS[1:], start=1):
        expr = expr.when(u % 9 == i, F.lit(ua))
    return expr


def fixture_lines(events: DataFrame, pages: DataFrame) -> DataFrame:
    """One log line per event, as a single string column ``value``."""
    page_urls = pages.select("page_id", F.col("url").alias("page_url"))
    n_pages, size = estimated_bytes(page_urls)  # one job: row count and size of the join side
    if n_pages <= 0:
        raise ValueError("pages is empty: no URL to put into the log lines")
    ev = events.select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("user_id").alias("u"),
        F.col("event_type").alias("kind"),
        "value",
        (F.col("event_id") % F.lit(n_pages)).alias("page_id"),
    )
    joined = join_small_side(ev, page_urls, "page_id", size=size)

    id_, u, kind = F.col("id"), F.col("u"), F.col("kind")
    ip = F.concat(F.lit("10.0."), (u % 4).cast("string"), F.lit("."), (u % 250).cast("string"))
    user = F.when(u % 10 == 0, F.lit("-")).otherwise(F.concat(F.lit("u"), u.cast("string")))
    # Some clients write local time; the wall clock is shifted so that the instant stays the event's.
    minutes = F.when(id_ % 31 == 0, F.lit(330)).when(id_ % 37 == 0, F.lit(-480)).otherwise(F.lit(0))
    offset = F.when(id_ % 31 == 0, F.lit(" +0530")).when(id_ % 37 == 0, F.lit(" -0800")).otherwise(F.lit(" +0000"))
    wall = F.timestamp_add("MINUTE", minutes, F.col("ts"))
    when = F.when(id_ % 83 == 0, F.lit("31/Feb/2024:00:00:00 +0000")).otherwise(
        F.concat(F.date_format(wall, "dd/MMM/yyyy:HH:mm:ss"), offset)
    )
    method = F.when(id_ % 13 == 0, F.lit("CONNECT")).when(kind == "purchase", F.lit("POST")).otherwise(F.lit("GET"))
    size_text = F.floor(F.col("value") * F.lit(10000)).cast("bigint").cast("string")
    nbytes = (
        F.when(id_ % 89 == 0, F.lit("abc"))
        .when(id_ % 9 == 0, F.lit("-"))
        .when(id_ % 41 == 0, F.concat(F.lit("+"), size_text))
        .when(id_ % 43 == 0, F.concat(F.lit("-"), size_text))
        .otherwise(size_text)
    )
    status = F.when(id_ % 103 == 0, F.lit("\uff14\uff10\uff14")).otherwise(_status(id_, kind).cast("string"))
    country = (
        F.when(id_ % 23 == 0, F.lit(""))
        .when(id_ % 29 == 0, F.lit(" TR "))
        .otherwise(F.concat(F.chr(F.lit(65) + u % 25), F.chr(F.lit(65) + (u * 7) % 26)))
    )
    line = F.concat(
        ip, F.lit(" - "), user,
        F.lit(" ["), when, F.lit('] "'),
        method, F.lit(" "), _url(id_, F.col("page_url")), F.lit(' HTTP/1.1" '),
        status, F.lit(" "), nbytes,
        F.lit(' "'), country, F.lit('" "'), _user_agent(u), F.lit('"'),
    )
    value = F.when(id_ % 97 == 0, F.concat(F.lit("truncated line "), id_.cast("string"))).otherwise(line)
    return joined.select(value.alias("value"))


def general_urls(pages: DataFrame) -> DataFrame:
    """(page_id, url): URLs in forms that plain traffic lacks, one form per page in turn."""
    n = F.col("page_id").cast("string")
    last = F.col("page_id") % 256
    forms = [
        F.concat(F.lit("http://h"), n, F.lit(".example/a/b/../c?x="), n),
        F.concat(F.lit("http://h"), n, F.lit(".example/a/./b/%2e%2E/")),
        F.concat(F.lit("http://0x7f.0.0."), last.cast("string"), F.lit("/p")),
        F.concat(F.lit("http://[0:0:0::"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("]:8080/x")),
        F.concat(F.lit("https://user:pw@H"), n, F.lit(".Example:443/s")),
        F.concat(F.lit("http:\\\\h"), n, F.lit(".example\\a\\b")),
        F.concat(F.lit("http://h"), n, F.lit(".example:"), (F.col("page_id") + 100_000).cast("string"), F.lit("/")),
        F.concat(F.lit("http://h"), n, F.lit('.example/{x}?q="'), n, F.lit('"')),
        F.concat(F.lit("file:///C|/dir/"), n),
        F.concat(F.lit("urn:isbn:"), n),
        F.concat(F.lit("foo://Host"), n, F.lit(":99/x/../y")),
        F.concat(F.lit("http://%ff"), n, F.lit(".example/")),
        F.concat(F.lit("http://h"), n, F.lit(".example/\u00e9?\u00fc")),
        F.concat(F.lit("http://1.2.3."), (F.col("page_id") + 256).cast("string"), F.lit("/")),
    ]
    form = F.element_at(F.array(*forms), (F.col("page_id") % len(forms) + 1).cast("int"))
    return pages.select("page_id", form.alias("url"))
