"""Key-value inputs derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.operators.merge import newest


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a mutation log: users are keys, errors are deletes; ``slice`` is the tenth of the
    log.  The number of events is a scalar subquery of the plan (a count from Parquet footers)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.greatest(events.agg(F.count("*")).scalar(), F.lit(1))
    return events.select(
        F.col("event_id").alias("seq"), F.format_string("user_%012d", "user_id").alias("key"), (F.col("event_type") == "error").alias("is_tombstone"),
        F.when(F.col("event_type") != "error", F.concat("event_type", F.lit("|"), "props")).alias("value"), F.call_function("div", F.col("event_id") * 10, n).alias("slice"),
    )


def tiers(log: DataFrame) -> DataFrame:
    """``src`` of each write: 0 the memtable, 1-4 level 0 from new to old, 5 and 6 level 1."""
    src = F.when(F.col("slice") >= 5, 9 - F.col("slice")).when(F.col("slice") >= 1, 5).otherwise(6)
    return log.withColumn("src", src.cast("int"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiers as sorted runs: the newest version of each key in each."""
    return newest(tiers(events_log(spark, sf_dir)), F.col("seq").desc(), by=("src", "key"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as appends of unique keys."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("seq"), F.format_string("key_%012d", "o_orderkey").alias("key"), F.concat("o_orderstatus", F.lit("|"), "o_orderpriority").alias("value"), F.lit(False).alias("is_tombstone"))
