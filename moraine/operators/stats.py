"""Nearest-rank percentiles: the element at ``floor(n * q / 100)`` of the sorted values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.operators.running import running


def latency_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """``n``, ``p50`` and ``p99`` of ``value`` per group.  Equal values are counted first, so a value that
    holds many rows is one; the wanted ranks are then found among the running counts."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = running(counts, F.col("_n"), value, by, "_before")
    totals = placed.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.sum("_n").alias("n"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    placed = placed.join(totals, same)

    def at(q: int):
        rank = F.expr(f"n * {q} div 100")
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col(value)))

    return placed.groupBy(*by).agg(F.first("n").alias("n"), at(50).alias("p50"), at(99).alias("p99"))
