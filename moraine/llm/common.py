"""Plumbing shared by the corpus operators: tables, checkpoints, row keys, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.sources.files import checkpointed, shared_folder as checkpoint_folder

__all__ = ["checkpoint_folder", "checkpointed", "components", "fresh", "given_back", "released", "table", "text_key"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, read through Spark only (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def released(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of tables that are no longer referenced: its cleaner acts when
    the driver collects garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def given_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over a task's batches, that ends by giving free memory back to the system:
    the worker process lives on, and what its allocators keep counts while others need it."""

    def batches_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
            if trim is not None:
                trim(0)

    return batches_of


def text_key(text: Column) -> Column:
    """128 bits of a text as one column; equal texts get equal keys, so that results can be joined back
    although ids may be repeated or null."""
    return F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(29), text).alias("k2"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected link table.

    ``links`` has columns ``a`` and ``b`` (long); direction, repeats and loops do not matter.
    Returns ``node``, ``component`` (the smallest node reachable) for every node that has a link
    to another.  Each round takes the smallest label among the neighbours and then the label of
    that label (pointer jumping), so stars need two rounds and chains a logarithmic number.  All
    state stays in distributed tables; each round is checkpointed.
    """
    both = links.where("a <> b").select("a", "b")
    both = checkpointed(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, labels.node == seen.a, "left").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        step = step.join(jump, step.label == jump.at, "left").select(
            "node", "before", F.least("label", "further").alias("label")
        )
        step = checkpointed(step)
        labels = step.select("node", "label")
        if not step.where("label <> before").limit(1).count():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
