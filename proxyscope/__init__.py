"""Web-proxy access-log analytics on Spark.

Log lines are read in parallel, parsed into a typed ``requests`` table with
native column expressions, stored as date-partitioned Parquet and queried
with DataFrame reports. Every operator is ``DataFrame -> DataFrame`` or
``Column -> Column``; nothing runs row by row in Python.
"""

from proxyscope.schema import REQUESTS_SCHEMA, REQUESTS_TABLE_SCHEMA
from proxyscope.session import get_spark, use_utc

__all__ = ["REQUESTS_SCHEMA", "REQUESTS_TABLE_SCHEMA", "get_spark", "use_utc"]
