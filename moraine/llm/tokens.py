"""Token counts by a separator scan over flat token files.

Documents are tokenised into streams of token identifiers, each document followed by the
end-of-document identifier.  A stream is cut into blocks of a fixed number of tokens, wherever that
falls, and holds no index.  Counting searches each block for separators with one vectorised compare;
a prefix scan over the blocks' summaries (tokens, separators, place of the last separator) stitches
documents that cross blocks and numbers them; the n-th document of a stream is the n-th of its list
of ids.

Defined cases: null and empty texts have 0 tokens; strings of special tokens are ordinary text; ids
may be null or repeated; a document may fill many blocks; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.common import checkpoint_folder

#: The public byte-level vocabulary leaves this identifier free.
END_OF_DOCUMENT = 50256


@lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as file:
        known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=known, special_tokens={})


def write_streams(documents: DataFrame, folder: str, ranks: str, pattern: str, end: int = END_OF_DOCUMENT, block: int = 1 << 19) -> None:
    """Tokenise ``doc_id``, ``text`` into ``folder``: rows ``stream``, ``block``, ``tokens`` (unsigned
    16-bit) and, in order, the streams' ids (``ids``; the tokens of those rows are null)."""
    id_type = dict(documents.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        stream, number, held, size, part = TaskContext.get().partitionId(), 0, [], 0, 0
        encode = encoder(ranks, pattern).encode_ordinary
        names = ["stream", "block", "tokens", "ids"]

        def row(number, tokens, ids):
            return pa.RecordBatch.from_arrays([pa.array([stream], pa.int32()), pa.array([number], pa.int32()), pa.array([tokens], pa.binary()), ids], names=names)

        for batch in batches:
            ids = batch.column("doc_id")
            none = pa.ListArray.from_arrays(pa.array([None, 0], pa.int32()), ids.slice(0, 0))
            for s in range(0, len(ids), 1000):
                own = ids.slice(s, 1000)
                yield row(part, None, pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
                part += 1
            for text in batch.column("text"):
                got = np.array(encode(text.as_py() or "") + [end], np.uint16)
                held.append(got)
                size += len(got)
                if size >= block:
                    whole = np.concatenate(held)
                    for s in range(0, size - block + 1, block):
                        yield row(number, whole[s : s + block].tobytes(), none)
                        number += 1
                    held, size = [whole[size - size % block :].copy()], size % block
        if size:
            yield row(number, np.concatenate(held).tobytes(), none)

    flat = documents.select("doc_id", "text").mapInArrow(run, f"stream int, block int, tokens binary, ids array<{id_type}>")
    flat.write.option("compression", "zstd").parquet(folder)


def count(streams: DataFrame, end: int = END_OF_DOCUMENT) -> DataFrame:
    """``doc_id``, ``n_tokens`` of each document of the streams (separators not counted)."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for stream, number, raw in zip(*[batch.column(c).to_pylist() for c in ("stream", "block", "tokens")]):
                tokens = np.frombuffer(raw, np.uint16)
                found = np.flatnonzero(tokens == end)
                inner = pa.array([np.diff(found).astype(np.int64) - 1], pa.list_(pa.int64()))
                first, last = (int(found[0]), int(found[-1])) if len(found) else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([stream], pa.int32()), pa.array([number], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([len(found)], pa.int64()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), inner], names=["stream", "block", "n", "ends", "first", "last", "inner"])

    blocks = streams.where("tokens is not null").select("stream", "block", "tokens").mapInArrow(scan, "stream int, block int, n long, ends long, first long, last long, inner array<long>")
    before = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("place", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    placed = placed.withColumn("open", F.coalesce(F.max(F.col("at") + F.col("last")).over(before) + 1, F.lit(0)))
    lengths = placed.where("ends > 0").select("stream", "place", F.posexplode(F.concat(F.array(F.col("at") + F.col("first") - F.col("open")), "inner")).alias("k", "n_tokens"))
    lengths = lengths.select("stream", (F.col("place") + F.col("k")).alias("place"), "n_tokens")
    parts = streams.where("tokens is null").select("stream", "block", "ids").withColumn("size", F.size("ids"))
    ids = parts.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).select(F.col("stream").alias("_stream"), "at", F.posexplode("ids").alias("k", "doc_id"))
    ids = ids.select("_stream", (F.col("at") + F.col("k")).alias("_place"), "doc_id")
    return lengths.join(ids, (F.col("stream") == F.col("_stream")) & (F.col("place") == F.col("_place"))).select("doc_id", "n_tokens")


def token_counts(documents: DataFrame, ranks: str, pattern: str, block: int = 1 << 19) -> DataFrame:
    """Tokenise and count, by way of streams in the session's shared folder."""
    spark = documents.sparkSession
    folder = f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_streams(documents, folder, ranks, pattern, block=block)
    return count(spark.read.parquet(folder))
