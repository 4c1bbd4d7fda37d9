"""Reading log files.

Lines are split at LF only (a lone CR inside a line is data), one CR before
the LF is dropped, and the text source splits large files across tasks, so a
directory of logs is read by one parallel job instead of file by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def without_cr(value: Column) -> Column:
    """Drop one CR at the end of a line (the CR of a CRLF line end).

    Byte-level: a regex would re-encode the text and hide invalid UTF-8.
    """
    return F.when(
        value.endswith("\r"), F.substr(value.cast("binary"), F.lit(1), F.octet_length(value) - 1).cast("string")
    ).otherwise(value)


def read_lines(spark: SparkSession, path: str | list[str], with_file: bool = False) -> DataFrame:
    """Lines of the text files at ``path`` (a file, directory or glob) as column ``value``.

    ``with_file=True`` adds ``file`` (the source file path) for per-file totals.
    """
    df = spark.read.option("lineSep", "\n").text(path)
    value = without_cr(F.col("value")).alias("value")
    if with_file:
        return df.select(value, F.col("_metadata.file_path").alias("file"))
    return df.select(value)


def file_totals(classified: DataFrame) -> DataFrame:
    """Per source file: ``file``, ``lines``, ``accepted``, ``rejected``.

    ``classified`` is ``classify_lines(read_lines(..., with_file=True))``.
    """
    return classified.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
    )


# Files whose totals one metric can hold: the sketch behind it takes 100,000 keys at most.
MOST_FILES = 50_000


def file_metric(files: int) -> Column:
    """Lines by source file and outcome of classified lines, as one observable aggregate for
    an input of at most ``files`` files (up to MOST_FILES). The sketch keeps a counter for each
    key as long as there are no more keys than it tracks, and then its counts are exact."""
    key = F.concat(F.col("file"), F.when(F.col("reason").isNull(), F.lit("+")).otherwise(F.lit("-")))
    keys = 2 * files
    return F.call_function("approx_top_k", key, F.lit(keys), F.lit(keys)).alias("by_file")


def read_file_metric(counts, lines: int) -> list[dict]:
    """``file_totals`` rows, ordered by file, from the value of ``file_metric``."""
    out: dict[str, dict] = {}
    for item, n in counts or []:
        row = out.setdefault(item[:-1], {"file": item[:-1], "lines": 0, "accepted": 0, "rejected": 0})
        row["lines"] += n
        row["accepted" if item[-1] == "+" else "rejected"] += n
    if sum(r["lines"] for r in out.values()) != lines:
        raise ValueError("totals by file do not add up to the lines read")
    return [out[f] for f in sorted(out)]
