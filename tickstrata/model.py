"""Schemas and constants of the telemetry model.

Times are epoch nanoseconds in LONG columns: Spark's timestamps hold microseconds only.
"""

from pyspark.sql import types as T

SHARD_NS = 604_800_000_000_000  # seven days
SMALL_RUN = 100_000_000  # bytes below which a file is a candidate for compaction
MIN_RUNS = 10  # a shard is compacted when it has more candidates than this
FUTURE_MS = 3_600_000  # how far ahead of now an event may be
DATA_MESSAGE = 80
DID_LIMIT = 1 << 32

TELEMETRY_FULL = T.StructType(
    [
        T.StructField("did", T.LongType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("key", T.ArrayType(T.IntegerType())),
        T.StructField("value", T.ArrayType(T.LongType())),
    ]
)
TELEMETRY = T.StructType([f for f in TELEMETRY_FULL if f.name != "key"])
STORED = T.StructType([*TELEMETRY, T.StructField("run_created_at", T.LongType()), T.StructField("shard_id", T.LongType())])
SOURCE_MESSAGE = "offset INT, created_at_ms BIGINT, did BIGINT, body STRING, length INT"
SOURCE_BODY = (
    "msg_type INT, status INT, msg_id INT, timestamp BIGINT, data STRUCT<timestamp: BIGINT, regs: ARRAY<ARRAY<BIGINT>>>, _corrupt STRING"
)
