"""Schemas and limits of the engine."""

from pyspark.sql import types as T

# Limits and thresholds of the data model.
KEY_LIMIT = 64 * 1024
VALUE_LIMIT = 1024 * 1024
MEMTABLE_BYTES = 4 * 1024 * 1024
LEVEL0_TRIGGER = 4
FALSE_POSITIVE_RATE = 0.01
PUT, REMOVE = 1, 2

#: One write.  ``seq`` is the total order of writes.
MUTATION = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)

#: One version of a key in a sorted run.  A tombstone is marked, never inferred from a null value.
SEGMENT_ROW = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("is_tombstone", T.BooleanType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("level", T.IntegerType(), False),
        T.StructField("file_id", T.LongType(), False),
    ]
)
