"""Declared schemas. Nothing is inferred."""

from pyspark.sql import types as T

# The parsed record: one row per accepted log line.
REQUESTS_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("remote_addr", T.StringType(), False),
        T.StructField("identd", T.StringType(), True),
        T.StructField("user_or_session", T.StringType(), True),
        T.StructField("method", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("scheme", T.StringType(), True),
        T.StructField("host", T.StringType(), True),
        T.StructField("port", T.IntegerType(), True),
        T.StructField("path", T.StringType(), True),
        T.StructField("query", T.StringType(), True),
        T.StructField("http_version", T.StringType(), False),
        T.StructField("status", T.IntegerType(), False),
        T.StructField("bytes", T.LongType(), True),
        T.StructField("country", T.StringType(), True),
        T.StructField("user_agent", T.StringType(), True),
        T.StructField("raw", T.StringType(), False),
    ]
)

REQUESTS_COLUMNS = [f.name for f in REQUESTS_SCHEMA.fields]

# Stored form: the same columns plus the UTC day, used as the partition key.
REQUESTS_TABLE_SCHEMA = T.StructType(
    [T.StructField(f.name, f.dataType, True) for f in REQUESTS_SCHEMA.fields]
    + [T.StructField("dt", T.DateType(), True)]
)

# Hourly partial aggregates of the stored table, by data file (see sources.partials).
PARTIALS_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType(), True),
        T.StructField("hour", T.LongType(), True),
        T.StructField("status", T.IntegerType(), True),
        T.StructField("browser", T.StringType(), True),
        T.StructField("n", T.LongType(), True),
        T.StructField("bytes_hi", T.LongType(), True),
        T.StructField("bytes_lo", T.LongType(), True),
        T.StructField("dt", T.DateType(), True),
    ]
)

# Output of classify_lines: the raw line, the reject reason (NULL when the
# line is accepted) and the parsed fields.
REJECT_REASONS = ("invalid_utf8", "no_match", "bad_timestamp", "bad_status", "bad_bytes")
