"""Column functions for the fields of a log line and for report keys.

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage
code generation; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line format, exactly as the reference states it (11 groups:
# ip, identd, user/session, timestamp, method, url, http version, status,
# bytes, country, user agent).
LINE_PATTERN = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+([^"]+)"\s+(\d{3})\s+(\S+)\s+"([^"]*)"\s+"([^"]*)"\s*$'
# The timestamp format, e.g. 15/Feb/2026:00:00:04 +0000.
TIMESTAMP_FORMAT = "d/MMM/yyyy:H:m:s Z"
N_GROUPS = 11

# The same pattern for Java's engine, with the same matches and groups:
# Unicode classes for \s \S \d (as in the reference's regex engine), an end
# anchor that cannot stop before a final line terminator, and linear time.
# Java backtracks (the reference's engine does not), so on a hostile line
# ``\s+([^"]+)"`` would retry every split of a long whitespace run before a
# failure later in the line. Here every quantifier is possessive, which is
# equivalent because each one is followed by a character it cannot match,
# except the version group: with greedy matching ``\s+`` gives back one
# character when only white space precedes the quote, so the version is
# either the text from the first non-space character, or the last white-space
# character (``\s*?(?=\s")`` expands one character at a time).
JAVA_LINE_PATTERN = (
    r'(?U)^(\S++)\s++(\S++)\s++(\S++)\s++\[([^\]]++)\]\s++"(\S++)\s++(\S++)'
    r'\s(?:\s*+(?=[^"\s])|\s*?(?=\s"))([^"]++)"\s++(\d{3})\s++(\S++)\s++"([^"]*+)"\s++"([^"]*+)"\s*+\z'
)
# A matched line is rewritten to its 11 groups joined by LF. Lines come from
# an LF-split text source, so LF cannot occur inside a group; lines that do
# contain LF take the exact per-group path instead.
_GROUPS_JOINED = "\n".join(f"${i}" for i in range(1, N_GROUPS + 1))


def with_line_groups(df: DataFrame, value_col: str, out_col: str) -> DataFrame:
    """Add ``out_col``: array<string> of the 11 groups, or NULL when the line does not match.

    One regex pass per line (a replace into an LF-joined form, then a split)
    instead of one pass per group. The split result is its own projection so
    the regex is not evaluated twice.
    """
    value = F.col(value_col)
    fast = F.when(
        F.instr(value, "\n") == 0,
        F.split(F.regexp_replace(value, F.lit(JAVA_LINE_PATTERN), F.lit(_GROUPS_JOINED)), "\n", -1),
    )
    exact = F.when(
        value.rlike(JAVA_LINE_PATTERN),
        F.array(*[F.regexp_extract(value, JAVA_LINE_PATTERN, i) for i in range(1, N_GROUPS + 1)]),
    )
    staged = df.withColumn("__fast", fast)
    groups = F.when(F.col("__fast").isNull(), exact).when(F.size(F.col("__fast")) == N_GROUPS, F.col("__fast"))
    return staged.withColumn(out_col, groups).drop("__fast")


def dash_to_null(c: Column) -> Column:
    """A lone ``-`` means "absent"."""
    return F.nullif(c, F.lit("-"))


# The Unicode White_Space code points, which are what ``\s``
# matches in the reference's regex engine and in Java's ``(?U)`` mode.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + (
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_unicode(c: Column) -> Column:
    """Strip leading and trailing Unicode white space (plain ``trim`` strips U+0020 only).

    ``trim(BOTH set FROM c)`` runs in linear time; a regex such as
    ``\\s+\\z`` would rescan a long inner run of spaces from every start.
    """
    return F.trim(c, F.lit(WHITE_SPACE))


def trim_to_null(c: Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(trim_unicode(c), F.lit(""))


def parse_log_ts(c: Column) -> Column:
    """``15/Feb/2026:00:00:04 +0000`` to an instant; NULL when invalid (31 Feb, second 60).

    The offset may also be written ``+hh:mm`` or ``+hh mm``; it is brought to
    ``+hhmm`` first (only when the third character from the end says so).
    """
    sep = F.substring(c, -3, 1)
    norm = F.when(
        sep.isin(":", " "), F.regexp_replace(c, r"([+-][0-9]{2})[: ]([0-9]{2})\z", "$1$2")
    ).otherwise(c)
    return F.try_to_timestamp(norm, F.lit(TIMESTAMP_FORMAT))


def parse_status(c: Column) -> Column:
    """Three-digit status to int; NULL for non-ASCII digits (the pattern's ``\\d``
    accepts them, the integer cast does not)."""
    return c.try_cast("int")


def parse_bytes(c: Column) -> Column:
    """Byte count as a signed 64-bit integer; NULL when the text is not one.

    The guard keeps Spark from accepting forms the reference refuses (a
    trailing control character, a decimal point).
    """
    return F.when(c.rlike(r"^[+-]?[0-9]+\z"), c.try_cast("bigint"))


# Time keys are arithmetic on the instant, so they mean UTC in any session zone.
def utc_day(ts: Column) -> Column:
    """UTC date of an instant (foldable, so a bound on it still prunes partitions)."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def hour_bucket(ts: Column) -> Column:
    """Hours since 1970-01-01 00:00 UTC."""
    return F.floor(F.unix_seconds(ts) / 3600)


def hour_text(hours: Column) -> Column:
    """Hour bucket as text with its UTC offset, e.g. ``2026-02-15 00:00:00+00``."""
    day = F.date_from_unix_date(F.floor(hours / 24).cast("int")).cast("string")
    return F.concat(day, F.lit(" "), F.lpad(F.pmod(hours, F.lit(24)).cast("string"), 2, "0"), F.lit(":00:00+00"))


def hour_of_day(ts: Column) -> Column:
    return F.pmod(hour_bucket(ts), F.lit(24)).cast("int")


def weekday_sun0(ts: Column) -> Column:
    """Day of week with Sunday = 0 (1970-01-01 was a Thursday)."""
    return F.pmod(F.floor(F.unix_seconds(ts) / 86400) + 4, F.lit(7)).cast("int")


# Browser families, first match wins (case-sensitive substrings):
# Chrome (Chrome, not Edg), Firefox, Safari (Safari, not Chrome), Edge (Edg),
# Opera, Bot (bot or Bot), otherwise Other.
def browser_family(ua: Column) -> Column:
    has = ua.contains
    return (
        F.when(has("Chrome") & ~has("Edg"), F.lit("Chrome"))
        .when(has("Firefox"), F.lit("Firefox"))
        .when(has("Safari") & ~has("Chrome"), F.lit("Safari"))
        .when(has("Edg"), F.lit("Edge"))
        .when(has("Opera"), F.lit("Opera"))
        .when(has("bot") | has("Bot"), F.lit("Bot"))
        .otherwise(F.lit("Other"))
    )


# Status classes and weekday names, in display order.
STATUS_CLASSES = ("2xx", "3xx", "4xx", "5xx", "Other")
WEEKDAY_NAMES = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def status_class(status: Column) -> Column:
    code = F.floor(status / F.lit(100)).cast("int")
    return F.when((code >= 2) & (code <= 5), F.concat(code.cast("string"), F.lit("xx"))).otherwise(F.lit("Other"))
