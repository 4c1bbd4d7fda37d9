"""Hourly partial aggregates of the stored table, kept up to date by imports.

One row per (data file, hour, status, browser family): a row count and an exact sum of bytes.
Rows of this table can be added up over any whole hours, so a report over years reads a few
hundred small rows per data file instead of its millions of requests.

* Mergeable: an import adds the rows of its own files; nothing written before changes.
* The file is part of the key, and says what is covered: a refresh lists the table's files
  and aggregates only those without rows here, so running it twice, or after a failure
  half way, adds nothing twice. All rows of a file are written by one task into one file.
* Partitioned by ``dt`` like the requests, so bounds prune days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxyscope.functions.fields import browser_family, hour_bucket
from proxyscope.operators.reports import exact_sum_parts
from proxyscope.schema import PARTIALS_SCHEMA
from proxyscope.sources.table import load_requests

KEYS = ("hour", "status", "browser")


def partial_columns() -> list[Column]:
    """The keys and values of a request as a partial row of its own."""
    b = F.coalesce(F.col("bytes"), F.lit(0).cast("bigint"))
    browser = F.when(F.col("user_agent").isNotNull(), browser_family(F.col("user_agent")))
    return [hour_bucket(F.col("ts")).alias("hour"), F.col("status"), browser.alias("browser"), b.alias("bytes")]


def _file_key(path: Column) -> Column:
    """A data file's day folder and name: the same however the table's place is written."""
    return F.regexp_extract(path, r"(dt=[^/]+/[^/]+)\z", 1)


def file_partials(requests: DataFrame) -> DataFrame:
    """Partial rows of stored requests by their data files."""
    rows = requests.select("dt", _file_key(F.col("_metadata.file_path")).alias("file"), *partial_columns())
    out = rows.groupBy("file", *KEYS, "dt").agg(F.count(F.lit(1)).alias("n"), *exact_sum_parts(F.col("bytes"), "bytes"))
    return out.select(*[f.name for f in PARTIALS_SCHEMA.fields])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_partials(spark: SparkSession, path: str) -> DataFrame:
    """The partials with their declared schema; none before the first refresh."""
    if not _exists(spark, path):
        return spark.createDataFrame([], PARTIALS_SCHEMA)
    return spark.read.schema(PARTIALS_SCHEMA).parquet(path)


def uncovered_files(spark: SparkSession, table_path: str, partials_path: str) -> list[str]:
    """Data files of the table without partial rows. Files are listed, not opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(table_path)
    listed = listed.where(F.col("dt").isNotNull()).select("path")  # files without a day hold rejected lines
    covered = load_partials(spark, partials_path).select(F.col("file").alias("covered")).distinct()
    new = listed.join(covered, _file_key(F.col("path")) == F.col("covered"), "left_anti")
    return [r.path for r in new.collect()]


def refresh_partials(spark: SparkSession, table_path: str, partials_path: str) -> int:
    """Add the rows of files not covered yet; returns how many files those were."""
    files = uncovered_files(spark, table_path, partials_path)
    if files:
        schema = load_requests(spark, table_path).schema
        rows = spark.read.schema(schema).option("basePath", table_path).parquet(*files)
        _write(file_partials(rows), partials_path, "append")
    return len(files)


def rebuild_partials(spark: SparkSession, table_path: str, partials_path: str, day: str) -> None:
    """Replace the rows of one day whose data files were rewritten."""
    rows = load_requests(spark, table_path).where(F.col("dt") == F.lit(day).cast("date"))
    _write(file_partials(rows), partials_path, "overwrite")


def _write(partials: DataFrame, path: str, mode: str) -> None:
    # a few hundred rows a data file: one file a day, so that a file's rows stay together
    out = partials.repartition("dt").write.mode(mode).partitionBy("dt").option("partitionOverwriteMode", "dynamic")
    out.option("compression", "zstd").parquet(path)
