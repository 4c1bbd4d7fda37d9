"""One table that directory imports and streams fill together, each log file once.

A ledger in the table's folder names the files that were taken. An import first claims its
files there, then writes their rows, then records the totals. Files that the ledger names
are never taken again; a file that changed after it was taken is reported instead.

* Every import has rows of its own: the table is partitioned by ``dt`` and ``import_id``, and an
  import replaces exactly its own partitions. A batch that a stream replays after a failure
  therefore adds nothing, and what a failed directory import left is removed by the next one.
* The ledger is a small Parquet table with one partition an import and one row a file. It is
  read and joined by Spark; the driver holds the names of the files it imports, in imports of
  at most FILES_PER_IMPORT.
* A claim is not a lock. Two imports that list the same new file in the same moment would both
  take it: leave the files of a running stream to that stream.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proxyscope.functions.fields import utc_day
from proxyscope.operators.parse import classify_lines
from proxyscope.schema import REQUESTS_COLUMNS, REQUESTS_TABLE_SCHEMA
from proxyscope.sources.table import COMPRESSED, LOG_FILES, WRITE_OPTIONS, import_metrics, unreadable
from proxyscope.sources.text import file_metric, read_file_metric, read_lines

FILES_PER_IMPORT = 10_000
LEDGER_SCHEMA = (
    "path string, length long, modified timestamp, state string, lines long, accepted long, rejected long, import_id string"
)
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
_BATCH = "dir-"


def _ledger_path(table_path: str) -> str:
    return f"{table_path.rstrip('/')}/_imports"


def _matching(spark: SparkSession, pattern: str):
    """The file system of a path pattern and the folders that match."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, [status.getPath() for status in fs.globStatus(path) or []]


def _remove(spark: SparkSession, pattern: str) -> None:
    fs, paths = _matching(spark, pattern)
    for path in paths:
        fs.delete(path, True)


def load_ledger(spark: SparkSession, table_path: str) -> DataFrame:
    """The files taken so far; ``state`` is ``claimed`` until their rows are stored, then ``done``."""
    if not _matching(spark, f"{_ledger_path(table_path)}/import_id=*")[1]:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(_ledger_path(table_path))


def load_ledgered(spark: SparkSession, table_path: str) -> DataFrame:
    """The requests of all imports, with ``dt``."""
    rows = spark.read.schema(REQUESTS_TABLE_SCHEMA).parquet(table_path)
    return rows.where(F.col("dt").isNotNull()).select(*REQUESTS_COLUMNS, "dt")


def _record(spark: SparkSession, table_path: str, rows: list[tuple]) -> None:
    out = spark.createDataFrame(rows, LEDGER_SCHEMA).coalesce(1).write.mode("overwrite")
    out.option("partitionOverwriteMode", "dynamic").partitionBy("import_id").parquet(_ledger_path(table_path))


def _plain(path: str) -> str:
    """A path with one slash after ``file:``, where Spark's sources write one or three."""
    return re.sub(r"^file:/+", "file:/", path)


def _import_files(spark: SparkSession, files: list[Row], table_path: str, import_id: str) -> dict:
    """Take ``files`` (path, length, modificationTime) as one import; its totals and ``files``."""
    _record(spark, table_path, [(f.path, f.length, f.modificationTime, "claimed", None, None, None, import_id) for f in files])
    _remove(spark, f"{table_path.rstrip('/')}/dt=*/import_id={import_id}")  # of an earlier try
    lines = read_lines(spark, [f.path for f in files], with_file=True)
    seen = Observation(f"import-{uuid.uuid4().hex}")
    classified = classify_lines(lines).observe(seen, *import_metrics(), file_metric(len(files)))
    rows = classified.where(F.col("reason").isNull()).select(
        *REQUESTS_COLUMNS, utc_day(F.col("ts")).alias("dt"), F.lit(import_id).alias("import_id")
    )
    out = rows.sortWithinPartitions("dt", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("dt", "import_id").options(**WRITE_OPTIONS).parquet(table_path)
    totals = seen.get
    by_file = read_file_metric(totals.pop("by_file"), int(totals["lines"]))
    found = {_plain(unquote(r["file"])): r for r in by_file}  # the metadata column is percent-encoded
    done = []
    for f in files:
        r = found.get(_plain(f.path), {"lines": 0, "accepted": 0, "rejected": 0})
        done.append((f.path, f.length, f.modificationTime, "done", r["lines"], r["accepted"], r["rejected"], import_id))
    _record(spark, table_path, done)
    return {**{k: int(v) for k, v in totals.items()}, "files": by_file}


def listed_files(spark: SparkSession, folder: str, pattern: str = LOG_FILES) -> DataFrame:
    """Files of a folder: path, length, modificationTime. They are listed, not opened.
    Empty files are left out: they are taken once they hold lines."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", "modificationTime")


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Those of ``files`` that no import has claimed."""
    return files.join(ledger.select("path").distinct(), "path", "left_anti")


def changed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Paths of ``files`` whose length or time is another than when they were taken."""
    taken = ledger.select(F.col("path").alias("taken"), F.col("length").alias("was"), "modified")
    changed = (F.col("length") != F.col("was")) | (F.col("modificationTime") != F.col("modified"))
    return files.join(taken, F.col("path") == F.col("taken")).where(changed).select("path")


def import_new(spark: SparkSession, folder: str, table_path: str, pattern: str = LOG_FILES) -> dict:
    """Import the files of ``folder`` that the ledger does not name yet.

    Returns the totals over these files, ``files`` (a dict per file with any lines),
    ``changed`` (paths taken before that have changed since: left as they are) and ``failed``
    (compressed files that cannot be read to their end: left out, and tried again next time).
    Run again after any failure, it first removes what the failed import left.
    """
    for r in load_ledger(spark, table_path).where("state = 'claimed'").select("import_id").distinct().collect():
        if r.import_id.startswith(_BATCH):  # a stream's claims stay until it replays the batch
            _release(spark, table_path, r.import_id)
    ledger = load_ledger(spark, table_path)
    files = listed_files(spark, folder, pattern)
    changed = sorted(r.path for r in changed_files(files, ledger).collect())
    todo = new_files(files, ledger).orderBy("path").collect()
    out: dict = {"files": [], "changed": changed, "failed": []}
    for at in range(0, len(todo), FILES_PER_IMPORT):
        part = todo[at : at + FILES_PER_IMPORT]
        import_id = f"{_BATCH}{uuid.uuid4().hex}"
        try:
            got = _import_files(spark, part, table_path, import_id)
        except Exception:
            _release(spark, table_path, import_id)
            bad = set(unreadable(spark, [f.path for f in part if f.path.endswith(COMPRESSED)]))
            if not bad:  # something else is wrong
                raise
            out["failed"] += sorted(bad)
            part = [f for f in part if f.path not in bad]
            got = _import_files(spark, part, table_path, import_id) if part else {"files": []}
        out["files"] += got.pop("files")
        for name, n in got.items():
            out[name] = out.get(name, 0) + n
    return {**dict.fromkeys(("lines", "accepted", "rejected"), 0), **out}


def _release(spark: SparkSession, table_path: str, import_id: str) -> None:
    """Remove the rows of an import, then its claims."""
    _remove(spark, f"{table_path.rstrip('/')}/dt=*/import_id={import_id}")
    _remove(spark, f"{_ledger_path(table_path)}/import_id={import_id}")


def take_batch(files: DataFrame, batch: int, table_path: str, name: str) -> None:
    """Import a micro-batch of file names that no other import has claimed."""
    spark = files.sparkSession
    import_id = f"{name}-{batch}"
    others = load_ledger(spark, table_path).where(F.col("import_id") != import_id)
    todo = new_files(files.select("path", "length", "modificationTime"), others).orderBy("path").collect()
    if todo:
        _import_files(spark, todo, table_path, import_id)


def stream_into(
    spark: SparkSession, folder: str, table_path: str, name: str, checkpoint_location: str | None = None,
    processing_time: str | None = None, max_files_per_trigger: int = 1_000, pattern: str = LOG_FILES,
) -> StreamingQuery:
    """Keep importing the new files of ``folder`` into the table that ``import_new`` also fills.

    The stream carries file names; each batch of them is one import, called ``name`` and the
    batch's number, so give every stream of a table a name of its own. The checkpoint lies in
    the table's folder unless given. Without ``processing_time`` it imports what is there and stops.
    """
    if not re.fullmatch(r"[A-Za-z0-9_]+", name) or name == _BATCH.rstrip("-"):
        raise ValueError("a stream's name has letters, digits and underscores, and is not 'dir'")
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern)
    files = files.option("maxFilesPerTrigger", min(max_files_per_trigger, FILES_PER_IMPORT)).load(folder)
    names = files.select("path", "length", "modificationTime")
    out = names.writeStream.foreachBatch(lambda batch, i: take_batch(batch, i, table_path, name))
    out = out.option("checkpointLocation", checkpoint_location or f"{table_path.rstrip('/')}/_stream_{name}")
    return (out.trigger(processingTime=processing_time) if processing_time else out.trigger(availableNow=True)).start()


def register_ledgered(spark: SparkSession, name: str, table_path: str) -> DataFrame:
    """The table as external catalog table ``name`` with its partitions recorded. Call it
    again after imports; time bounds then list only the days they need."""
    quoted = ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))
    location = "'" + table_path.replace("\\", "\\\\").replace("'", "\\'") + "'"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in REQUESTS_TABLE_SCHEMA.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted} ({columns}, import_id string) USING parquet "
        f"PARTITIONED BY (dt, import_id) LOCATION {location}"
    )
    spark.sql(f"ALTER TABLE {quoted} RECOVER PARTITIONS")
    return spark.table(quoted).select(*REQUESTS_COLUMNS, "dt")
