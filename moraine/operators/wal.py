"""The mutation log: sizes, checksums and replay of the valid prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.operators.maintain import memtable


def valid_prefix(log: DataFrame, damaged: Column) -> DataFrame:
    """Records before the first damaged one.  One scalar aggregate, joined as a single row."""
    first = log.where(damaged).agg(F.min("seq").alias("_first"))
    return log.join(F.broadcast(first), F.col("_first").isNull() | (F.col("seq") < F.col("_first"))).drop("_first")


def replayed(log: DataFrame, damaged: Column | None = None) -> DataFrame:
    """The memtable that replaying the log gives."""
    return memtable(log if damaged is None else valid_prefix(log, damaged))
