"""The heart of the engine: the newest version of each key, and hiding deletions.

The order of steps is the semantics: range filter, newest version, tombstone filter, sort, limit.
The range filter touches the key only, so Spark pushes it through the window into the scan; the
tombstone filter must stay above it.  ``row_number() = 1`` is planned with a group limit before the
shuffle, so a key with very many versions sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(versions: DataFrame, *order: Column, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The first row of each key under ``order``; tombstones are kept."""
    ranked = versions.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def latest(log: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The last write of each key of a mutation log."""
    return newest(log, F.col("seq").desc(), by=by)


def merged(runs: DataFrame) -> DataFrame:
    """One row per key from runs ranked by ``src`` (0 is the newest)."""
    return newest(runs, F.col("src").asc())


def live(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("is_tombstone"))


def in_range(rows: DataFrame, start=None, end=None) -> DataFrame:
    """Keys in ``[start, end)``; an empty or missing bound is open."""
    if start:
        rows = rows.where(F.col("key") >= F.lit(start))
    if end:
        rows = rows.where(F.col("key") < F.lit(end))
    return rows


def union_runs(*runs: DataFrame) -> DataFrame:
    """Runs ordered from newest to oldest, as one table with ``src``."""
    out = None
    for k, run in enumerate(runs):
        run = run.select("key", "value", "is_tombstone", F.lit(k).alias("src"))
        out = run if out is None else out.unionByName(run)
    if out is None:
        raise ValueError("no runs")
    return out
