"""Ordered logs of entries: as batches of rows, and as a file of framed entries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from moraine.sources.files import Files


def append(entries: DataFrame, folder: str) -> None:
    """Append rows that carry their place in ``seq``; a batch shows as a whole or not at all."""
    entries.write.mode("append").parquet(folder)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).orderBy("seq")


def framed(data: bytes) -> Iterator[bytes]:
    """The entries of a file: a 32-bit little-endian length and the body of each.  A length that is cut
    off ends the log (its writer never got further); a body that is cut off is an error."""
    at = 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        if at + 4 + size > len(data):
            raise EOFError(f"the entry at byte {at} has {len(data) - at - 4} of its {size} bytes")
        yield data[at + 4 : at + 4 + size]
        at += 4 + size


class LogFile:
    """A file of framed entries, each flushed before ``append`` returns.  For small logs: the entries
    are read by the driver."""

    def __init__(self, spark: SparkSession, folder: str, name: str):
        self._files, self.name, self._out = Files(spark, folder), name, None

    def append(self, body: bytes) -> None:
        if self._out is None:
            self._files.make()
            self._out = self._files.create(self.name)
        self._out.write(bytearray(len(body).to_bytes(4, "little") + body))
        self._out.hflush()

    def read(self) -> list[bytes]:
        return list(framed(self._files.read_bytes(self.name))) if self._files.exists(self.name) else []

    def close(self) -> None:
        if self._out is not None:
            self._out.close()
            self._out = None
