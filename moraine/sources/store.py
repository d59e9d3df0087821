"""A durable store: manifest, logs, sorted runs.

Every change publishes a new manifest version that no other writer can have; the manifest alone says
which files exist, so half-written files of a failed job are never seen.  Readers are bound to one
version.  Files are deleted by ``vacuum`` only, so running scans keep theirs.  One writer at a time: a
version that another writer has published first is an error.

A single put is in the log of single writes, flushed, before it returns.  Its memtable is the driver's,
bounded by ``memtable_bytes`` of held bytes, overwritten values included; ``write`` takes a DataFrame
of mutations of any size.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.functions.encoding import size_of
from moraine.operators import read
from moraine.operators.merge import latest, live, merged
from moraine.schemas import LEVEL0_TRIGGER, MEMTABLE_BYTES, MUTATION, PUT, REMOVE, SEGMENT_ROW
from moraine.sources.files import Files
from moraine.sources.wal import Wal, records

_EMPTY = {"version": 0, "segments": [], "log": [], "wal": None, "next_seq": 0, "next_file": {"0": 0, "1": 0}}


class Conflict(RuntimeError):
    """Another writer has published this version."""


def _tombstone() -> Column:
    """Whether a mutation removes its key; an op of no known kind fails the job."""
    return F.when(F.col("op").isin(PUT, REMOVE), F.col("op") == REMOVE).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.col("op").cast("string"))).cast("boolean"))


class View:
    """An immutable version of a store: what was committed and buffered when it was taken."""

    def __init__(self, store: Store, manifest: dict, buffered: list[tuple]):
        self._store, self.manifest, self._buffered = store, manifest, buffered

    def _tail(self, start: bytes = b"", end: bytes = b"", key: bytes | None = None) -> DataFrame | None:
        """The log's rows; of the buffered ones only those that the range or key asks for."""
        spark, out = self._store.spark, None
        shifts: dict[int, list[str]] = {}  # a batch's own numbers follow those of earlier ones
        for b in self.manifest["log"]:
            shifts.setdefault(b["shift"], []).append(self._store.file(b["path"]))
        parts = [spark.read.schema(MUTATION).parquet(*paths).withColumn("seq", F.col("seq") + shift) for shift, paths in shifts.items()]
        own = [r for r in self._buffered if (bytes(r[2]) == key if key is not None else bytes(r[2]) >= start and (not end or bytes(r[2]) < end))]
        if own:
            parts.append(spark.createDataFrame(own, MUTATION))
        for part in parts:
            out = part if out is None else out.unionByName(part)
        return out

    def runs(self, start: bytes = b"", end: bytes = b"", key: bytes | None = None) -> DataFrame:
        """Ranked versions; runs whose key range cannot match are left out on the driver."""
        def may_hold(s: dict) -> bool:
            low, high = bytes.fromhex(s["min_key"]), bytes.fromhex(s["max_key"])
            if key is not None:
                return low <= key <= high
            return (not end or low < end) and high >= start

        spark = self._store.spark
        chosen = [s for s in self.manifest["segments"] if may_hold(s)]
        out = spark.createDataFrame([], T.StructType([*SEGMENT_ROW.fields[:3], T.StructField("src", T.LongType())]))
        # ``seq`` orders versions like the runs do, and also places late writes of a stream.
        if chosen:
            rows = spark.read.schema(SEGMENT_ROW).parquet(*[self._store.file(s["path"]) for s in chosen])
            out = rows.select("key", "value", "is_tombstone", (-F.col("seq")).alias("src"))
        tail = self._tail(start, end, key)
        if tail is not None:
            own = latest(tail).select("key", "value", _tombstone().alias("is_tombstone"), (-F.col("seq")).alias("src"))
            out = own.unionByName(out) if chosen else own
        return out

    def scan(self, start: bytes = b"", end: bytes = b"", limit: int = 0) -> DataFrame:
        return read.scan(self.runs(start, end), start, end, limit)

    def get(self, key: bytes) -> bytes | None:
        if not self._buffered and not self.manifest["log"] and not any(bytes.fromhex(s["min_key"]) <= key <= bytes.fromhex(s["max_key"]) for s in self.manifest["segments"]):
            return None  # outside of every run: no job
        rows = read.get(self.runs(key=key), key).take(1)
        return bytes(rows[0]["value"] or b"") if rows else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return read.multi_get(self.runs(), keys)


class Store:
    def __init__(self, spark: SparkSession, path: str, memtable_bytes: int = MEMTABLE_BYTES):
        self.spark, self.memtable_bytes, self._files = spark, memtable_bytes, Files(spark, path)
        self._files.make()
        self.manifest = self._read()
        self._buffer: list[tuple] = []
        self._memory: dict[bytes, bytes | None] = {}
        self._held = 0  # bytes of the buffer, overwritten values included
        self._bytes = self._tail_bytes()
        self._wal: Wal | None = None
        if self.manifest["wal"] and self._files.exists(self.manifest["wal"]):
            for op, key, value in records(self._files.read_bytes(self.manifest["wal"])):
                self._remember(op, key, value)

    @classmethod
    def open(cls, spark: SparkSession, path: str, memtable_bytes: int = MEMTABLE_BYTES) -> Store:
        return cls(spark, path, memtable_bytes)

    def file(self, name: str) -> str:
        return f"{self._files.root}/{name}"

    def _versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self._files.names() if n.startswith("manifest-") and n.endswith(".json"))

    def _read(self, version: int | None = None) -> dict:
        version = version if version is not None else (self._versions() or [0])[-1]
        return json.loads(self._files.read(f"manifest-{version:012d}.json")) if version else json.loads(json.dumps(_EMPTY))

    def _commit(self, **changes) -> None:
        new = json.loads(json.dumps(self.manifest | changes)) | {"version": self.manifest["version"] + 1}
        if not self._files.publish(f"manifest-{new['version']:012d}.json", json.dumps(new)):
            raise Conflict(f"version {new['version']} is taken")
        self.manifest = new

    # writes

    def put(self, key: bytes, value: bytes) -> None:
        self._apply(PUT, bytes(key), bytes(value))

    def remove(self, key: bytes) -> None:
        """Write a tombstone, whether or not the key exists."""
        self._apply(REMOVE, bytes(key), None)

    def _remember(self, op: int, key: bytes, value: bytes | None) -> None:
        self._buffer.append((self.manifest["next_seq"] + len(self._buffer), op, bytearray(key), None if value is None else bytearray(value)))
        self._held += len(key) + len(value or b"")
        self._bytes += (0 if key in self._memory else len(key)) - len(self._memory.get(key) or b"") + len(value or b"")
        self._memory[key] = value

    def _apply(self, op: int, key: bytes, value: bytes | None) -> None:
        if self._wal is None:
            name = f"wal-{uuid.uuid4().hex}"
            wal = Wal(self._files, name)
            if self._buffer:  # records of an earlier lifetime, whose log may end in a torn one
                for _, o, k, v in self._buffer:
                    wal.append(o, bytes(k), None if v is None else bytes(v))
            self._commit(wal=name)
            self._wal = wal
        self._wal.append(op, key, value)
        self._remember(op, key, value)
        if self._bytes >= self.memtable_bytes:
            self.flush()
            self.maybe_compact()
        elif self._held >= self.memtable_bytes:  # overwritten values count here
            self.sync()

    def _end_wal(self) -> None:
        if self._wal is not None:
            self._wal.close()
        self._wal, self._buffer, self._held = None, [], 0

    def sync(self) -> None:
        """Move the buffered writes from the log of single writes to a batch of rows."""
        if self._buffer:
            rows = self._buffer
            path = f"log-{uuid.uuid4().hex}"
            self.spark.createDataFrame(rows, MUTATION).coalesce(1).write.parquet(self.file(path))
            self._commit(log=[*self.manifest["log"], {"path": path, "shift": 0, "bytes": self._held}], next_seq=rows[-1][0] + 1, wal=None)
            self._end_wal()

    def write(self, mutations: DataFrame, renumber: bool = True) -> None:
        """Append ``seq``, ``op``, ``key``, ``value``.  ``seq`` orders rows within the batch, which
        follows all earlier writes; without ``renumber`` it is their place among all writes.  Rows
        without a number or a key, or of an unknown op, make the whole batch an error.

        The batch is evaluated once: its numbers are read from the written file, and shifted by readers.
        """
        self.sync()
        path = f"log-{uuid.uuid4().hex}"
        mutations.select(F.col("seq").cast("long"), F.col("op").cast("byte"), F.col("key").cast("binary"), F.col("value").cast("binary")).write.parquet(self.file(path))
        bad = F.col("seq").isNull() | F.col("key").isNull() | F.col("op").isNull() | ~F.col("op").isin(PUT, REMOVE)
        low, high, size, wrong = self.spark.read.schema(MUTATION).parquet(self.file(path)).agg(F.min("seq"), F.max("seq"), F.sum(size_of(F.col("key")) + size_of(F.col("value"))), F.count_if(bad)).first()
        if low is None or wrong:
            self._files.delete(path)
            if wrong:
                raise ValueError(f"{wrong} rows have no number or key, or an unknown op")
            return
        base = self.manifest["next_seq"]
        shift = base - low if renumber else 0
        self._commit(log=[*self.manifest["log"], {"path": path, "shift": shift, "bytes": size}], next_seq=max(base, high + shift + 1))
        self._memory.clear()  # the batch may hold newer versions of its keys
        self._bytes = self._tail_bytes()
        if self._bytes >= self.memtable_bytes:
            self.flush()
            self.maybe_compact()

    def _tail_bytes(self) -> int:
        """Bytes of the tail's batches: what its memtable has at most."""
        return sum(b["bytes"] for b in self.manifest["log"])

    # maintenance

    def _write_segment(self, rows: DataFrame, level: int) -> tuple[dict | None, dict]:
        file_id = self.manifest["next_file"][str(level)]
        path = f"segment-{level}-{file_id}-{uuid.uuid4().hex}"
        rows = rows.select("key", "value", "is_tombstone", "seq", F.lit(level).alias("level"), F.lit(file_id).cast("long").alias("file_id"))
        rows.orderBy("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(self.file(path))
        stats = self.spark.read.schema(SEGMENT_ROW).parquet(self.file(path)).agg(F.count("*"), F.min("key"), F.max("key"), F.sum(size_of(F.col("key")) + size_of(F.col("value")))).first()
        numbers = self.manifest["next_file"] | {str(level): file_id + 1}
        if not stats[0]:
            return None, numbers
        return {"level": level, "file_id": file_id, "path": path, "n_entries": stats[0], "min_key": bytes(stats[1]).hex(), "max_key": bytes(stats[2]).hex(), "n_bytes": stats[3]}, numbers

    def flush(self) -> None:
        """Turn the tail, buffered writes included, into a run of level 0 and start an empty log."""
        tail = self.view()._tail()
        if tail is None:
            return
        segment, numbers = self._write_segment(latest(tail).withColumn("is_tombstone", _tombstone()), 0)
        self._commit(segments=self.manifest["segments"] + ([segment] if segment else []), log=[], wal=None, next_seq=self.manifest["next_seq"] + len(self._buffer), next_file=numbers)
        self._end_wal()
        self._memory.clear()
        self._bytes = 0

    def segments(self, level: int) -> list[dict]:
        return [s for s in self.manifest["segments"] if s["level"] == level]

    def maybe_compact(self) -> bool:
        if len(self.segments(0)) < LEVEL0_TRIGGER:
            return False
        self.compact()
        return True

    def maintain(self) -> None:
        """What a background thread would do: flush a full tail, merge level 0 if it has enough runs.
        Writes call it by themselves; after opening a store that was left with work, call it once."""
        if self._bytes >= self.memtable_bytes:
            self.flush()
        self.maybe_compact()

    def _merge(self, inputs: list[dict], keep_tombstones: bool) -> None:
        view = View(self, self.manifest | {"segments": inputs, "log": []}, [])
        rows = merged(view.runs()) if keep_tombstones else live(merged(view.runs()))
        segment, numbers = self._write_segment(rows.withColumn("seq", -F.col("src")), 1)
        gone = {s["path"] for s in inputs}
        self._commit(segments=[s for s in self.manifest["segments"] if s["path"] not in gone] + ([segment] if segment else []), next_file=numbers)

    def compact(self) -> None:
        """Merge all runs of level 0 into one of level 1; tombstones stay, as level 1 may hold their keys."""
        if self.segments(0):
            self._merge(self.segments(0), True)

    def major_compact(self) -> None:
        """Merge all runs into one without tombstones."""
        self.flush()
        if self.manifest["segments"]:
            self._merge(self.manifest["segments"], False)

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete what none of the newest ``keep_versions`` versions names.  Views of older versions
        end with this."""
        kept = self._versions()[-keep_versions:]
        used = {x for v in kept for m in [self._read(v)] for x in [m["wal"], *(f["path"] for f in [*m["segments"], *m["log"]])]}
        gone = [n for n in self._files.names() if (n.startswith(("segment-", "log-", "wal-")) and n not in used) or (n.startswith("manifest-") and int(n[9:-5]) not in kept)]
        for name in gone:
            self._files.delete(name)
        return gone

    def close(self) -> None:
        """Close the log of single writes, which the next lifetime replays; nothing is flushed."""
        if self._wal is not None:
            self._wal.close()
            self._wal = None

    # reads

    def view(self) -> View:
        return View(self, json.loads(json.dumps(self.manifest)), list(self._buffer))

    def get(self, key: bytes) -> bytes | None:
        if bytes(key) in self._memory:
            value = self._memory[bytes(key)]
            return None if value is None else bytes(value)
        return self.view().get(bytes(key))

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return self.view().multi_get(keys)

    def scan(self, start: bytes = b"", end: bytes = b"", limit: int = 0) -> DataFrame:
        return self.view().scan(bytes(start), bytes(end), limit)
