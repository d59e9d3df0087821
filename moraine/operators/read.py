"""Point lookups and range scans over ranked runs (``key``, ``value``, ``is_tombstone``, ``src``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.merge import in_range, live, merged
from moraine.operators.running import running


def scan(runs: DataFrame, start=None, end=None, limit: int = 0) -> DataFrame:
    """Live keys of ``[start, end)`` in key order; ``limit`` counts live rows, 0 is unlimited."""
    rows = live(merged(in_range(runs, start, end))).select("key", "value").orderBy("key")
    return rows.limit(limit) if limit else rows


def numbered(rows: DataFrame) -> DataFrame:
    """``pos`` from 1 in key order.  Places are counted per key range, so no task sorts all."""
    return running(rows, F.lit(1), "key", name="pos").withColumn("pos", F.col("pos") + 1)


def get(runs: DataFrame, key) -> DataFrame:
    """The live value of one key, or no row.  The newest run that has the key decides."""
    return live(merged(runs.where(F.col("key") == F.lit(key)))).select("key", "value")


def lookup(run: DataFrame, key) -> DataFrame:
    """What one run knows of a key: no row (absent), a tombstone, or a value."""
    return run.where(F.col("key") == F.lit(key)).select("key", "is_tombstone", "value")


def multi_get(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """Live values of many keys (column ``key``).  The semi join comes before the merge; Spark
    broadcasts the keys only if they are small."""
    return live(merged(runs.join(keys.select("key").distinct(), "key", "left_semi"))).select("key", "value")


def get_status(runs: DataFrame, keys: DataFrame) -> DataFrame:
    """``key``, ``status`` (OK, NOT_FOUND, INVALID_ARGUMENT) and ``value`` of each asked key."""
    from moraine.functions.encoding import key_status

    found = multi_get(runs, keys).withColumn("_found", F.lit(True)).withColumnRenamed("key", "_key")
    out = keys.select("key").join(found, F.col("key") == F.col("_key"), "left")
    status = F.when(key_status(F.col("key")) != "OK", "INVALID_ARGUMENT").when(F.col("_found"), "OK").otherwise("NOT_FOUND")
    return out.select("key", status.alias("status"), F.when(status == "OK", F.col("value")).alias("value"))
