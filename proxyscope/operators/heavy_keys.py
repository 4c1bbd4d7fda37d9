"""Exact top-k of keys that are nearly unique, without a shuffle of all keys.

Hosts and above all paths can have billions of distinct values, of which a report names 15.
Counting them all moves every distinct key through the shuffle. Here a count sketch of
fixed size goes first: each key falls into one bucket in each of ``ROWS`` hash rows, and all
buckets are counted, so what moves does not depend on the number of keys.

* A bucket's count is at least that of each key in it, so the least of a key's bucket
  counts is an upper bound for it. Sketches add up, and the bound holds for sums.
* The keys whose buckets are among the fullest are counted exactly. The k-th largest of
  these counts, ``floor``, is reached by k keys for certain.
* A key with a bucket count below ``floor`` has a lower count than k others: it cannot be
  among the first k, also not by a tie. All other keys are counted exactly and ranked.

So the result is exact for any data. With flat counts ``floor`` is low and most keys are
counted, as without a sketch; with any skew only a few are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxyscope.operators.filters import Bound, time_range
from proxyscope.operators.reports import TOP_HOSTS, TOP_PATHS, exact_sum, exact_sum_parts

ROWS = 2
BUCKETS = 1 << 16
TRIED = 8  # buckets counted first, for each key asked for


def _buckets(key: str, rows: int, buckets: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(r), F.col(key)), F.lit(buckets)).cast("int").alias(f"_b{r}") for r in range(rows)]


def sketch(df: DataFrame, key: str, rows: int = ROWS, buckets: int = BUCKETS) -> DataFrame:
    """(row, bucket, n): at most ``rows * buckets`` rows, for any number of keys."""
    entries = df.select(F.posexplode(F.array(*_buckets(key, rows, buckets))).alias("row", "bucket"))
    return entries.groupBy("row", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _within(df: DataFrame, key: str, counts: list[dict[int, int]], floor: int, buckets: int) -> DataFrame:
    """Rows whose key's buckets all hold ``floor`` rows or more. The buckets, bounded by the
    sketch's size, are sent to the tasks."""
    spark = df.sparkSession
    names = df.columns
    out = df.select("*", *_buckets(key, len(counts), buckets))
    for r, count in enumerate(counts):
        full = [(b,) for b, n in count.items() if n >= floor]
        if len(full) == len(count):
            continue  # leaves nothing out
        out = out.join(F.broadcast(spark.createDataFrame(full, f"_b{r} int")), f"_b{r}", "left_semi")
    return out.select(*names)


def candidates(df: DataFrame, key: str, k: int, rows: int = ROWS, buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``df`` (key not null) whose keys may be among the ``k`` most frequent ones; all
    rows of those that are, ties included."""
    counts: list[dict[int, int]] = [{} for _ in range(rows)]
    for r in sketch(df, key, rows, buckets).collect():  # at most rows * buckets
        counts[r.row][r.bucket] = r.n
    tried = min((sorted(c.values(), reverse=True)[: TRIED * k][-1] if c else 0) for c in counts)
    exact = _within(df, key, counts, tried, buckets).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    best = [r.n for r in exact.orderBy(F.col("n").desc()).limit(k).collect()]
    floor = best[-1] if len(best) == k else 0
    return _within(df, key, counts, floor, buckets)


def top_hosts(requests: DataFrame, start: Bound = None, end: Bound = None, limit: int = TOP_HOSTS) -> DataFrame:
    """R2 by two passes: the same rows as ``reports.top_hosts``."""
    df = time_range(requests, start, end).where(F.col("host").isNotNull()).select("host")
    found = candidates(df, "host", limit).groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.col("n").desc(), F.col("host")).limit(limit)


def top_paths(requests: DataFrame, start: Bound = None, end: Bound = None, limit: int = TOP_PATHS) -> DataFrame:
    """R8 by two passes: the same rows as ``reports.top_paths``."""
    b = F.coalesce(F.col("bytes"), F.lit(0).cast("bigint"))
    df = time_range(requests, start, end).where(F.col("path").isNotNull() & (F.col("path") != "/")).select("path", b.alias("b"))
    found = candidates(df, "path", limit).groupBy("path").agg(F.count(F.lit(1)).alias("n"), *exact_sum_parts(F.col("b"), "b"))
    top = found.orderBy(F.col("n").desc(), F.col("path")).limit(limit)
    avg = exact_sum("b").cast("double") / F.col("n").cast("double")
    return top.select("path", "n", (avg / F.lit(1024.0)).cast("bigint").alias("avg_kb"))
