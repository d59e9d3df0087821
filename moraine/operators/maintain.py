"""Flush, compaction and run statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.functions.encoding import index_entry_size, run_entry_size, size_of
from moraine.operators.merge import latest, live, merged
from moraine.operators.running import running
from moraine.schemas import FALSE_POSITIVE_RATE


def memtable(log: DataFrame) -> DataFrame:
    """The log's tail as a memtable: one row per key, tombstones kept."""
    return latest(log).select("key", "value", "is_tombstone", "seq")


def memtable_bytes(table: DataFrame) -> DataFrame:
    """Keys and bytes of a memtable: a key's bytes count once, and a live value's bytes."""
    return table.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(size_of(F.col("key")) + F.when(F.col("is_tombstone"), 0).otherwise(size_of(F.col("value")))), F.lit(0)).cast("long").alias("n_bytes"))


def flushed(log: DataFrame, by: str) -> DataFrame:
    """Runs that flushing each part ``by`` of the log gives: one row per key and part."""
    return latest(log, by=(by, "key"))


def compacted(runs: DataFrame) -> DataFrame:
    """Any number of runs merged into one; tombstones are kept, as older runs may hold their keys."""
    return merged(runs).select("key", "value", "is_tombstone")


def major_compacted(runs: DataFrame) -> DataFrame:
    """A merge of all runs of a store, after which tombstones hide nothing and go."""
    return live(merged(runs)).select("key", "value")


def bounds(runs: DataFrame, *by: str) -> DataFrame:
    """Entries, tombstones and key range of each run."""
    return runs.groupBy(*by).agg(F.count("*").alias("n_entries"), F.sum(F.col("is_tombstone").cast("long")).alias("n_tombstones"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


def offsets(runs: DataFrame, by: str) -> DataFrame:
    """Where each entry of a run starts in its data block: sums per key range, so a run is not one task's."""
    sized = runs.withColumn("entry_bytes", run_entry_size(F.col("is_tombstone"), F.col("key"), F.col("value")))
    return running(sized, F.col("entry_bytes"), "key", (by,), "entry_offset")


def file_size(runs: DataFrame, by: str, rate: float = FALSE_POSITIVE_RATE) -> DataFrame:
    """Bytes of each run's data, index and filter, and of the whole file with its footer."""
    entry = run_entry_size(F.col("is_tombstone"), F.col("key"), F.col("value"))
    sums = runs.groupBy(by).agg(F.sum(entry).alias("data_bytes"), F.sum(index_entry_size(F.col("key"))).alias("index_bytes"), F.count("*").alias("n"))
    bits = F.ceil(-F.col("n") * math.log(rate) / (math.log(2) * math.log(2)))
    sums = sums.withColumn("filter_bytes", (F.lit(16) + F.ceil(bits / 8)).cast("long"))
    return sums.select(by, "data_bytes", "index_bytes", "filter_bytes", (F.col("data_bytes") + F.col("index_bytes") + F.col("filter_bytes") + 24).alias("file_bytes"))


def flush_numbers(rows: DataFrame, number: str, entry_bytes: int, limit: int) -> DataFrame:
    """Which flush each append of a fixed size goes to: a flush takes the entry that fills it."""
    per_flush = math.ceil(limit / entry_bytes)
    return rows.withColumn("flush_no", F.expr(f"{number} div {per_flush}"))
