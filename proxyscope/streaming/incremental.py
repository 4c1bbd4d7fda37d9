"""Incremental import of a log directory with Structured Streaming.

The batch importer appends whatever it is given, so importing a file twice
stores its rows twice. This importer instead watches a directory: each run
(``availableNow``) or each trigger (``processingTime``) parses only the files
not seen before and appends their accepted rows to a date-partitioned table.

* Exactly once: the checkpoint records the files read, and the table's sink log the
  batches committed. The two belong together, so the checkpoint lies inside the table
  folder unless a location is given, and a run whose checkpoint is new while the
  table already has a sink log is refused: it would number its batches from 0 again and the
  sink would drop them as already committed.
* Only finished files: a file is read once, when it is first seen. Lines appended later
  never arrive, so move files into the folder when they are complete. Only names
  that match ``pattern`` are read.
* No state: parsing is a narrow per-line projection, so there is nothing to
  watermark and a lost executor only re-runs its tasks.
* Files are zstd-compressed like batch appends; log files arrive in time
  order, so each written file already covers a narrow time range.
* Totals per micro-batch (lines, accepted, rejected per reason) are observed
  while writing and reported in ``query.lastProgress["observedMetrics"]``.

The sink keeps its own file log, so a table written this way is read through
that log (``load_requests`` does this); do not mix it with batch appends.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proxyscope.operators.parse import classify_lines
from proxyscope.sources.table import PARQUET_COLUMN_OPTIONS, import_metrics, with_dt
from proxyscope.sources.text import without_cr

TOTALS = "import_totals"


def default_checkpoint(table_path: str) -> str:
    """Inside the table folder, on its file system; readers skip names with an underscore."""
    return f"{table_path.rstrip('/')}/_import_checkpoint"


def _has_entries(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(path) and len(fs.listStatus(path)) > 0


def incremental_import(
    spark: SparkSession,
    source_dir: str,
    table_path: str,
    checkpoint_location: str | None = None,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
    pattern: str = "*.log",
) -> StreamingQuery:
    """Start importing new files of ``source_dir`` into ``table_path``.

    With ``processing_time`` (e.g. ``"1 minute"``) the query keeps running and
    picks up files as they arrive; without it, it imports what is there now
    and stops (``availableNow``). Returns the running query.
    """
    checkpoint = checkpoint_location or default_checkpoint(table_path)
    if _has_entries(spark, f"{table_path.rstrip('/')}/_spark_metadata") and not _has_entries(spark, f"{checkpoint.rstrip('/')}/offsets"):
        raise ValueError(f"{table_path} was filled with another checkpoint than {checkpoint}: new batches would be dropped")
    reader = spark.readStream.format("text").option("lineSep", "\n").option("pathGlobFilter", pattern)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.load(source_dir).select(without_cr(F.col("value")).alias("value"))
    classified = classify_lines(lines)
    accepted = with_dt(classified.observe(TOTALS, *import_metrics()).where(F.col("reason").isNull()))
    writer = (
        accepted.writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .option("compression", "zstd")
        .options(**PARQUET_COLUMN_OPTIONS)
        .partitionBy("dt")
        .outputMode("append")
    )
    writer = writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)
    return writer.start()
