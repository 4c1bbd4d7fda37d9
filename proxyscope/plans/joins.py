"""Join placement with a checked size bound.

A side is broadcast only after an aggregate has measured it; past the bound
the join is left to Spark's shuffle strategies (sort-merge or shuffle hash,
re-planned by AQE with skew splitting).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default bound for an explicit broadcast: well under the driver and executor
# memory of a typical node, and under Spark's 8 GB hard limit.
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024

_FIXED_WIDTH = {
    T.ByteType: 1,
    T.ShortType: 2,
    T.IntegerType: 4,
    T.LongType: 8,
    T.FloatType: 4,
    T.DoubleType: 8,
    T.DateType: 4,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.BooleanType: 1,
}


def estimated_bytes(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of ``df`` measured by one aggregate over its columns."""
    width: list[Column] = [F.lit(16)]  # per-row overhead of an unsafe row
    for field in df.schema.fields:
        fixed = _FIXED_WIDTH.get(type(field.dataType))
        if fixed is not None:
            width.append(F.lit(fixed))
        elif isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width.append(F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + F.lit(8))
        else:
            width.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(field.name)))), F.lit(0)))
    total = width[0]
    for w in width[1:]:
        total = total + w
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(total.cast("long")).alias("bytes")).first()
    return int(row["rows"] or 0), int(row["bytes"] or 0)


def join_small_side(
    big: DataFrame,
    small: DataFrame,
    on,
    how: str = "inner",
    max_bytes: int = DEFAULT_BROADCAST_BYTES,
    size: int | None = None,
) -> DataFrame:
    """Join ``big`` with ``small``; broadcast ``small`` only if measured under ``max_bytes``.

    Past the bound the join is planned by Spark (sort-merge or shuffle hash).
    ``size`` may pass a measurement the caller already made.
    """
    if size is None:
        _, size = estimated_bytes(small)
    right = F.broadcast(small) if size <= max_bytes else small
    return big.join(right, on, how)
