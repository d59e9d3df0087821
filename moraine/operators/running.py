"""Running sums in an order, without a task that holds all rows of a group.

Rows are dealt to ranges of (group, order) once, and kept so: what counts and what is counted must see
the same ranges.  A running sum is then the sum within the range plus that of the group's earlier ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.sources.files import checkpointed


def running(rows: DataFrame, amount: Column, order: str, by: tuple[str, ...] = (), name: str = "before") -> DataFrame:
    """``rows`` with ``name``: the sum of ``amount`` over the earlier rows of the group ``by`` (rows of
    equal ``order`` in one group come in any order)."""
    ranges = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = checkpointed(rows.withColumn("_amount", amount).repartitionByRange(ranges, *by, order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.withColumn("_inner", F.coalesce(F.sum("_amount").over(within), F.lit(0)))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range", *by).agg(F.sum("_amount").alias("_sum"))  # a row for each range and group
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    sums = sums.select(F.col("_range").alias("_r"), *[F.col(b).alias(f"_{b}") for b in by], "_earlier")
    same = F.col("_range") == F.col("_r")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return inner.join(sums, same).select(*rows.columns, (F.col("_inner") + F.col("_earlier")).cast("long").alias(name))
