"""Continuous ingestion of mutations.  Last write by ``seq`` wins, so a late row changes nothing and no
watermark is needed: a tombstone can never expire."""

from __future__ import annotations

from pyspark.sql import DataFrame

from moraine.sources.store import Store


def ingest(mutations: DataFrame, store: Store, checkpoint: str):
    """Append each micro-batch to the store's log (and flush it when full); returns the running query.

    A batch that is delivered again after a failure is written again with the same content, which
    leaves the newest version of each key as it is.
    """
    return (
        mutations.writeStream.foreachBatch(lambda batch, _: store.write(batch, renumber=False))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingest_files(mutations: DataFrame, folder: str, checkpoint: str):
    """Append the stream to a folder of mutation files that any reader merges by ``seq``."""
    return mutations.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
