"""The stored ``requests`` table: date-partitioned Parquet.

* Partition key ``dt`` = UTC date of ``ts``; time-range reports prune whole
  days through it (see ``operators.filters``).
* Rows are sorted by ``ts`` inside each task before writing (log files are
  nearly in time order already, so the sort is cheap). Every report filters
  on time, and time-ordered row groups let Parquet min/max statistics on
  ``ts`` skip the parts of a day outside the range; with ``dt`` partitions
  this replaces the timestamp index of a single-node database. (A host-major
  order would spread every hour over all row groups of a day.)
* Files are zstd-compressed: about a quarter smaller than Spark's default
  snappy for this table, at the same write speed, which is what scans of a
  large table are bound by.
* Host and path have Parquet bloom filters: a lookup of one host reads only the row groups
  that may hold it. Columns of few values (status, country) are skipped by dictionary.
* ``compact_day`` rewrites one day into fewer files, in time order or clustered by host.
* Rejected lines can be kept by the same write (``keep_rejects``): they have no ``ts``, so
  they lie in the partition without a day, which ``load_requests`` prunes.
* Appends need no shuffle: every task writes its own files, at most one per
  day it holds, each capped by ``maxRecordsPerFile``. Log files are written
  in time order, so a task's split covers few days.
* Writes go through Spark's commit protocol, so a lost executor or failed
  task never leaves partial files in the table.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from proxyscope.functions.fields import utc_day
from proxyscope.operators.filters import time_range
from proxyscope.operators.parse import classify_lines
from proxyscope.schema import REQUESTS_COLUMNS, REQUESTS_TABLE_SCHEMA, REJECT_REASONS
from proxyscope.sources.text import MOST_FILES, file_metric, file_totals, read_file_metric, read_lines

DEFAULT_MAX_RECORDS_PER_FILE = 5_000_000

# The whole line and the URL are close to unique per row: a dictionary for
# them only costs time before Parquet falls back to plain encoding (about 15%
# of the write, for 2% more bytes).
PARQUET_COLUMN_OPTIONS = {"parquet.enable.dictionary#raw": "false", "parquet.enable.dictionary#url": "false"}

# Bloom filters take a few percent of the file. They are sized for this many
# values of a row group, and left out where a column chunk is all dictionary (that is exact already).
_BLOOM_OPTIONS = {
    f"parquet.bloom.filter.{name}#{column}": value
    for column, values in (("host", "20000"), ("path", "200000"))
    for name, value in (("enabled", "true"), ("expected.ndv", values))
}
WRITE_OPTIONS = {"compression": "zstd", **PARQUET_COLUMN_OPTIONS, **_BLOOM_OPTIONS}


def with_dt(requests: DataFrame) -> DataFrame:
    """The stored form of parsed rows: their columns and ``dt``, the UTC day of ``ts``."""
    return requests.select(*REQUESTS_COLUMNS, utc_day(F.col("ts")).alias("dt"))


def append_requests(
    requests: DataFrame, path: str, max_records_per_file: int = DEFAULT_MAX_RECORDS_PER_FILE
) -> None:
    """Append parsed rows to the table at ``path`` (created when missing)."""
    _append(with_dt(requests), path, max_records_per_file)


def _append(rows: DataFrame, path: str, max_records_per_file: int = DEFAULT_MAX_RECORDS_PER_FILE) -> None:
    out = rows.sortWithinPartitions("dt", "ts").write.mode("append").option("maxRecordsPerFile", max_records_per_file)
    out.partitionBy("dt").options(**WRITE_OPTIONS).parquet(path)


def compact_day(
    spark: SparkSession, path: str, day: str, files: int, cluster_by: str | None = None,
    max_records_per_file: int = DEFAULT_MAX_RECORDS_PER_FILE,
) -> None:
    """Rewrite one day (``2026-02-15``) into about ``files`` files, leaving other days alone.

    Rows are dealt by ranges of time, so each file covers one stretch of the day. With
    ``cluster_by`` (``host``, say) they are dealt by ranges of that column, then time:
    statistics and bloom filters then leave a lookup of one value a file or two, at the price
    of reading all files for a stretch of the day. The day's old files go when the new ones
    are committed; a reader that listed them before must start again. Partials of the table
    name data files, so call ``partials.rebuild_partials`` for the day afterwards.
    """
    keys = [cluster_by, "ts"] if cluster_by else ["ts"]
    rows = load_requests(spark, path).where(F.col("dt") == F.lit(day).cast("date"))
    out = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt")
    writer.option("maxRecordsPerFile", max_records_per_file).options(**WRITE_OPTIONS).parquet(path)


def host_requests(requests: DataFrame, host: str, start=None, end=None) -> DataFrame:
    """All requests of one host in a time range, by the row-group filters of the stored table."""
    return time_range(requests, start, end).where(F.col("host") == host)


def load_requests(spark: SparkSession, path: str) -> DataFrame:
    """The table with its declared schema (no inference); ``dt`` comes from the folder names."""
    return spark.read.schema(REQUESTS_TABLE_SCHEMA).parquet(path).where(F.col("dt").isNotNull())


def load_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines that imports with ``keep_rejects`` rejected: ``raw`` and ``reason``."""
    rows = spark.read.schema(StructType([*REQUESTS_TABLE_SCHEMA.fields, StructField("reason", StringType())])).parquet(path)
    return rows.where(F.col("dt").isNull()).select("raw", "reason")


def register_requests_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Register the table folder at ``path`` as catalog table ``name`` and return it.

    The table is external (dropping it keeps the files) and partitioned by
    ``dt``, with its partitions recorded in the catalog. A time-bounded report
    on it lists only the matching day folders, not every file of the table,
    which matters once the table holds about a million files. Call it again
    after an import to record new days (``RECOVER PARTITIONS``). This is for
    tables filled by ``import_logs``; a folder written by the streaming import
    is read through its sink log with ``load_requests``.
    """
    table = ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))
    location = "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in REQUESTS_TABLE_SCHEMA.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY (dt) LOCATION {location}"
    )
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table).where(F.col("dt").isNotNull())


def import_logs(
    spark: SparkSession,
    source: str | list[str],
    table_path: str,
    max_records_per_file: int = DEFAULT_MAX_RECORDS_PER_FILE,
    rebalance_partitions: int | None = None,
    keep_rejects: bool = False,
    files: int = 0,
) -> dict:
    """Read log files, parse them and append the accepted rows, in one job.

    Returns the totals of the run: ``lines``, ``accepted``, ``rejected`` and one
    count per reject reason. They are gathered with ``DataFrame.observe``
    while the rows are written, so the input is read and parsed once.

    Plain text is split into byte ranges, so one big file is read by many
    tasks. A gzip file cannot be split: Spark reads it in one task. When a few
    large compressed files hold most of the lines, ``rebalance_partitions=n``
    deals the parsed rows to ``n`` ranges of time before they are written, so
    that each file still covers one stretch of time and a day with many rows is
    spread over several (one shuffle of the rows, after a pass that samples
    them; decompression itself stays one task per file). Leave it unset for
    splittable input, where the shuffle would only add cost.

    With ``keep_rejects`` the same pass also stores the rejected lines and their reasons
    (``load_rejects``): two sinks of one write, so the input is still parsed once.

    With ``files`` (a bound on the number of source files) the totals hold ``files``, a dict
    per file with any lines: ``file``, ``lines``, ``accepted``, ``rejected``. They come from the
    same pass, so they add up to the totals also where a file grows meanwhile.
    """
    classified = classify_lines(read_lines(spark, source, with_file=files > 0))
    metrics = import_metrics() + ([file_metric(files)] if files else [])
    if rebalance_partitions and keep_rejects:
        raise ValueError("rejected lines have no time: give rebalance_partitions or keep_rejects, not both")
    if rebalance_partitions:
        # Range partitioning samples its input first, which would observe every row twice.
        totals = classified.agg(*metrics).first().asDict()
        accepted = with_dt(classified.where(F.col("reason").isNull()))
        append_requests(accepted.repartitionByRange(rebalance_partitions, "dt", "ts"), table_path, max_records_per_file)
    else:
        obs = Observation("import_totals")
        seen = classified.observe(obs, *metrics)
        if keep_rejects:
            day = F.when(F.col("reason").isNull(), utc_day(F.col("ts")))
            _append(seen.select(*REQUESTS_COLUMNS, "reason", day.alias("dt")), table_path, max_records_per_file)
        else:
            append_requests(seen.where(F.col("reason").isNull()), table_path, max_records_per_file)
        totals = obs.get
    counts = totals.pop("by_file", None)
    out = {k: int(v) for k, v in totals.items()}
    return {**out, "files": read_file_metric(counts, out["lines"])} if files else out


def import_metrics() -> list[Column]:
    """Totals of classified lines: all, accepted, rejected, and per reject reason."""
    return [
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
    ] + [F.count_if(F.col("reason") == r).alias(r) for r in REJECT_REASONS]


# File name ends that stand for a compressed file: its text may break off or be garbled.
COMPRESSED = (".gz", ".bz2", ".zst", ".deflate", ".lz4", ".snappy")


# ``*.log``, and the same with a known compressed end; ``a.log.bak`` and ``a.log.tmp`` are no logs.
LOG_FILES = "*.log{" + ",".join(("", *COMPRESSED)) + "}"


def import_directory(spark: SparkSession, folder: str, table_path: str, pattern: str = LOG_FILES, **options) -> dict:
    """Import the files of a folder; files that cannot be read are reported, not imported.

    Returns the totals of ``import_logs``, ``files`` (one dict per imported file: ``file``,
    ``lines``, ``accepted``, ``rejected``) and ``failed`` (the files left out). All files are
    first imported as one job, which commits all rows or none. Only if it fails is each
    compressed file read through by a job of its own, and the sound ones are then imported
    as one job; so no file is imported in part. Totals by file come from the writing pass; only
    for more than MOST_FILES files are they counted by a second one.
    """
    paths = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").orderBy("path").collect()]
    if not paths:
        return {**dict.fromkeys(("lines", "accepted", "rejected", *REJECT_REASONS), 0), "files": [], "failed": []}
    failed: list[str] = []
    nothing = {**dict.fromkeys(("lines", "accepted", "rejected", *REJECT_REASONS), 0), "files": []}
    few = len(paths) if len(paths) <= MOST_FILES else 0
    try:
        totals = import_logs(spark, paths, table_path, files=few, **options)
    except Exception:
        failed = unreadable(spark, [p for p in paths if p.endswith(COMPRESSED)])
        if not failed:  # something else is wrong
            raise
        paths = [p for p in paths if p not in set(failed)]
        totals = import_logs(spark, paths, table_path, files=few, **options) if paths else nothing
    if "files" not in totals:
        per_file = file_totals(classify_lines(read_lines(spark, paths, with_file=True)))
        totals["files"] = [r.asDict() for r in per_file.orderBy("file").collect()]
    return {**totals, "failed": failed}


def unreadable(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files whose text cannot be read to its end, each tried by a Spark job."""

    def broken(path: str) -> bool:
        try:
            spark.read.text(path).agg(F.count("value")).first()
        except Exception:  # noqa: BLE001  any failure to read it is the answer
            return True
        return False

    with ThreadPoolExecutor(8) as pool:
        return [p for p, bad in zip(paths, pool.map(broken, paths), strict=True) if bad]


def table_coverage(requests: DataFrame) -> DataFrame:
    """One row: ``n`` rows, ``first_ts`` and ``last_ts``."""
    return requests.agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def stored_coverage(spark: SparkSession, path: str) -> DataFrame:
    """``table_coverage`` of the stored table without reading it through.

    Rows are counted by day from the Parquet footers: the count is pushed into the scan, which
    reads no column (this needs Spark's newer file reader, so it is set for a session of its
    own). The first and last instant then come from the ``ts`` of the first and last day only.
    """
    meta = spark.newSession()
    meta.conf.set("spark.sql.sources.useV1SourceList", "")
    meta.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    ends = rows_by_day(meta, path).agg(F.sum("n").alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last")).first()
    days = load_requests(spark, path).where(F.col("dt").isin(ends["first"], ends["last"]))
    n = F.lit(ends["n"] or 0).cast("long").alias("n")
    return days.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(n, "first_ts", "last_ts")


def rows_by_day(spark: SparkSession, path: str) -> DataFrame:
    """Rows of each stored day (``dt``, ``n``)."""
    return load_requests(spark, path).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))
