"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of other characters than these six.
WORD = r"[^\x20\x09-\x0D]+"

SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def doc_crc(name: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def _scratch_root(spark: SparkSession) -> str:
    """Folder of this application below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own; a
    cluster without it is an error, as executors do not share local folders.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpus-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/corpus-{spark.sparkContext.applicationId}"
    if path not in _ROOTS:
        _ROOTS.add(path)
        atexit.register(_remove, spark, path)
    return path


_ROOTS: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    """Delete this application's stage tables; the session may be gone by then."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the JVM has ended: the cluster's own cleaning is left
        pass


def stage(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder (in parts by a column) and read it again:
    cuts the lineage, so that a lost executor repeats only what follows."""
    spark = df.sparkSession
    path = f"{_scratch_root(spark)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROW_KEY = ("_row_text", "_row_place")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` and the columns ROW_KEY (64 bits each), which tell its rows apart also where
    doc_ids repeat or are null: hashes of the text, and of the row's file and place in it. They
    are the same in every pass over the rows; what is not a plain Parquet table is written as
    one first. The text comes first, so the order of rows under one id is that of their texts."""
    if not re.fullmatch(r"Relation .* parquet\s*", docs._jdf.queryExecution().analyzed().toString()):
        docs = stage(docs)
    file = docs.metadataColumn("_metadata")
    place = F.xxhash64(file["file_path"], file["row_index"])
    return docs.select("*", F.xxhash64("text").alias(ROW_KEY[0]), place.alias(ROW_KEY[1]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES, most_rows: int = 1 << 10) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most ``most_rows`` rows and about ``limit`` bytes: first row, end row, their bytes, and their
    offsets into these. One longer text is a slice of its own."""
    if not len(column):
        return
    data, offsets = utf8(column)
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), start + most_rows, n)
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed: splitmix64


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Everything in ASCII that is not a letter; bytes of other characters count as letters.
NOT_LETTER = np.arange(256) < 128
NOT_LETTER[65:91] = NOT_LETTER[97:123] = False


class Words:
    """The words of a slice of texts: byte ranges, hashes and the row that holds each.

    Words are split at the bytes marked in ``between`` (the six ASCII white-space characters)
    and hashed (64 bits) with A-Z in lower case; texts are kept apart even without white space between them.
    """

    __slots__ = ("start", "end", "hash", "row", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE):
        n = len(data)
        space = between[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets[offsets <= n]] = True
        inside = ~space
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        begins = inside & (~before | edge[:n])
        after = np.concatenate([inside[1:], [False]]) if n else inside
        ends = inside & (~after | edge[1:])
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        power = _powers(_BASE, n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        inverse = _powers(_INVERSE, n + 1)
        self.hash = mix64((total[self.end] - total[self.start]) * inverse[self.start])
        self.first = np.searchsorted(self.start, offsets)  # first word of each row, and the end
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the row of each. A text of fewer words has
    one shingle, its whole word sequence; a text without words has none."""
    h, row, first = words.hash, words.row, words.first
    count = np.diff(first)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    position = np.arange(n) - first[row]
    left = count[row] - position
    total = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        take = h[j:] if j else h
        part = mix64(take * np.uint64(2 * j + 1) + np.uint64(j))
        if j:
            part = np.concatenate([part, np.zeros(j, np.uint64)])
            part = np.where(left > j, part, np.uint64(0))
        total += part
    keep = (left >= width) | (position == 0)
    return mix64(total[keep]), row[keep]
