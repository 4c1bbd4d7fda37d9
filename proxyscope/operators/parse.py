"""Line parsing: raw text lines to the typed ``requests`` frame.

One narrow (shuffle-free) projection per line. A line is rejected, in this
order, when it is not valid UTF-8, does not match the line pattern, has an
invalid timestamp, a status that is not a number, or a byte count that is
neither ``-`` nor a 64-bit integer. Rejected lines are not lost: they keep
their reason and can be counted or inspected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxyscope.functions.fields import (
    dash_to_null,
    with_line_groups,
    parse_bytes,
    parse_log_ts,
    parse_status,
    trim_to_null,
)
from proxyscope.functions.url import with_url_parts
from proxyscope.schema import REQUESTS_COLUMNS


def _g(i: int) -> Column:
    return F.col("_g")[i - 1]


def classify_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """All lines with their parsed fields and ``reason`` (NULL = accepted).

    Extra columns of ``lines`` (e.g. the source file) are carried along.
    """
    extra = [c for c in lines.columns if c != value_col]
    value = F.col(value_col)
    valid_utf8 = F.is_valid_utf8(value)
    staged = lines.select(*extra, value.alias("raw"), valid_utf8.alias("_utf8"))
    staged = with_line_groups(staged.withColumn("_v", F.when(F.col("_utf8"), F.col("raw"))), "_v", "_g")
    staged = with_url_parts(staged.withColumn("_url", _g(6)), "_url", "_u")
    bytes_text = _g(9)
    parsed = staged.select(
        *extra,
        "raw",
        "_utf8",
        "_g",
        "_u",
        parse_log_ts(_g(4)).alias("ts"),
        parse_status(_g(8)).alias("status"),
        F.when(bytes_text != "-", parse_bytes(bytes_text)).alias("bytes"),
    )
    reason = (
        F.when(~F.col("_utf8"), F.lit("invalid_utf8"))
        .when(F.col("_g").isNull(), F.lit("no_match"))
        .when(F.col("ts").isNull(), F.lit("bad_timestamp"))
        .when(F.col("status").isNull(), F.lit("bad_status"))
        .when((_g(9) != "-") & F.col("bytes").isNull(), F.lit("bad_bytes"))
    )
    fields = [
        *[F.col(c) for c in extra],
        F.col("ts"),
        _g(1).alias("remote_addr"),
        dash_to_null(_g(2)).alias("identd"),
        dash_to_null(_g(3)).alias("user_or_session"),
        _g(5).alias("method"),
        _g(6).alias("url"),
        F.col("_u.scheme").alias("scheme"),
        F.col("_u.host").alias("host"),
        F.col("_u.port").alias("port"),
        F.col("_u.path").alias("path"),
        F.col("_u.query").alias("query"),
        _g(7).alias("http_version"),
        F.col("status"),
        F.col("bytes"),
        trim_to_null(_g(10)).alias("country"),
        trim_to_null(_g(11)).alias("user_agent"),
        F.col("raw"),
        reason.alias("reason"),
    ]
    # The parsed row leaves through a one-row generator. Catalyst does not
    # push a filter on generator output below the generator, so later
    # predicates (accepted rows, host present, a time range) run on the
    # parsed columns instead of being rewritten into the parsing expressions,
    # which would copy the shared parsing stages into every predicate.
    return parsed.select(F.inline(F.array(F.struct(*fields))))


def parse_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Accepted lines only, in the ``requests`` schema."""
    return classify_lines(lines, value_col).where(F.col("reason").isNull()).select(*REQUESTS_COLUMNS)


def rejected_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Rejected lines: ``raw`` and ``reason``."""
    return classify_lines(lines, value_col).where(F.col("reason").isNotNull()).select("raw", "reason")


def rejects_by_reason(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Count of rejected lines per reason (``reason string, n bigint``)."""
    return (
        classify_lines(lines, value_col)
        .where(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def import_totals(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """One row: ``lines``, ``accepted``, ``rejected`` (bigint)."""
    classified = classify_lines(lines, value_col).select("reason")
    return classified.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
    )
