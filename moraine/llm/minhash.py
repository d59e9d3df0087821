"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

A document's set of word shingles gets a signature of ``coordinates`` minima.  Equal sets are
collapsed to one representative.  Representatives are posted under each (coordinate, value) pair.
Two sets that agree in at least ``matches`` of the coordinates must meet in one of their
``coordinates - matches + 1`` rarest postings (prefix filter), so only those lists are merged, and
lists with one document are skipped.  Collisions of the pairs that meet are counted on the whole
signatures; pairs at or above ``matches`` are confirmed on the full sets, unless their sketches
already show that they differ in too many shingles.

Lists are merged in two steps, so that large groups of copies do not become all their pairs: first
each list against its few most central documents (those whose coordinates most others share: the
original of a group rather than one of its copies), which links most copies; then, in lists that still
hold documents of different components, all pairs between different components, in blocks.  Pairs
within one component are skipped: they cannot change it; so are pairs whose sizes rule the similarity
out.  No list, block or partner is capped.

Defined cases: null or empty texts, and texts without words, have the empty set and link with
nothing, as do rows without an id; rows of one id are one node; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.common import checkpointed, components, given_back
from moraine.llm.shingles import CHUNK, buffers, chunks, mix, shingle_sets

COORDINATES, MATCHES = 48, 27
#: Bits of a set's parity sketch: bit b is the parity of the number of shingles that hash to b.  Two
#: sketches differ in at most as many bits as the sets differ in shingles, so no link is lost by it.
PARITY = 2048
#: Documents of a list that it is first merged against.
PIVOTS = 3


def _coefficients(n: int) -> np.ndarray:
    return np.random.default_rng(97).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(documents: DataFrame, words: int, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``h1``, ``h2`` (128 bits that equal sets share), ``keys`` (one
    coordinate-value key per coordinate) and ``parity`` (the sketch); null for the empty set."""
    id_type = dict(documents.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa

        factors = _coefficients(coordinates)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            total = len(batch)
            count, h1, h2 = np.zeros(total, np.int64), np.zeros(total, np.uint64), np.zeros(total, np.uint64)
            keys = np.zeros((total, coordinates), np.int64)
            parity = np.zeros((total, PARITY // 64), np.int64)
            for first, last in chunks(offsets):
                row, shingle = shingle_sets(data, offsets[first : last + 1], words)
                if not len(row):
                    continue
                begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                at = first + row[begins]
                count[at] = np.diff(np.r_[begins, len(row)])
                h1[at], h2[at] = np.add.reduceat(shingle, begins), np.add.reduceat(mix(shingle ^ np.uint64(0xA5A5A5A5)), begins)
                odd = np.bincount((row - row[0]) * PARITY + (shingle & np.uint64(PARITY - 1)).astype(np.int64), minlength=(int(row[-1] - row[0]) + 1) * PARITY) & 1
                parity[first + row[0] : first + row[-1] + 1] = np.packbits(odd.astype(bool)).view(np.int64).reshape(-1, PARITY // 64)
                for k in range(coordinates):
                    low = np.minimum.reduceat((shingle * factors[k]) >> np.uint64(24), begins)
                    keys[at, k] = (mix(low + np.uint64(k << 40)) >> np.uint64(1)).astype(np.int64)
            has = count > 0
            signed = lambda x: pa.array(x.view(np.int64))
            rows = lambda x: pa.compute.if_else(pa.array(has), pa.ListArray.from_arrays(pa.array(np.arange(total + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())), None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), signed(h1), signed(h2), rows(keys), rows(parity)], names=["doc_id", "n_shingles", "h1", "h2", "keys", "parity"])

    import pyarrow.compute  # noqa: F401

    return documents.select("doc_id", "text").mapInArrow(given_back(run), f"doc_id {id_type}, n_shingles long, h1 long, h2 long, keys array<long>, parity array<long>")


def compressed(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``packed`` (the text's bytes, compressed, so that less is shuffled)."""
    id_type = dict(documents.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa

        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [press.compress(t.as_buffer()) if t.is_valid else b"" for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    return documents.select("doc_id", "text").mapInArrow(given_back(run), f"doc_id {id_type}, packed binary")


def shingles_of(held: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``shingles`` (array of 64-bit hashes) of compressed texts."""
    id_type = dict(held.dtypes)["doc_id"]

    def run(batches):
        import pyarrow as pa

        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            at, packed = 0, batch.column("packed")
            while at < len(batch):
                texts, size, first = [], 0, at
                while at < len(batch) and (not texts or size < CHUNK):
                    texts.append(unpress.decompress(packed[at].as_buffer()))
                    size += len(texts[-1])
                    at += 1
                data = np.frombuffer(b"".join(texts), np.uint8)
                row, shingle = shingle_sets(data, np.cumsum([0, *map(len, texts)]), words)
                bounds = np.searchsorted(row, np.arange(at - first + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(shingle.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, at - first), lists], names=["doc_id", "shingles"])

    return held.select("doc_id", "packed").mapInArrow(given_back(run), f"doc_id {id_type}, shingles array<long>")


def confirmed(pairs: DataFrame, held: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs ``a``, ``b``, those with ``100 * |intersection| >= percent * |union|`` of the
    full sets of documents a and b."""
    pairs = checkpointed(pairs)
    wanted = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "_id")
    sets = shingles_of(held.join(wanted, held.doc_id == wanted._id, "left_semi"), words)
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, block: int = 256) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row of ``documents``
    (``doc_id``, ``text``).  ``matches`` is to be set so that a pair at ``percent`` reaches it almost
    surely: with 48 and 27, a pair at 80 per cent falls short about once in 10,000."""
    documents = documents.select("doc_id", "text")
    signed = checkpointed(signatures(documents, words, coordinates))
    reps = checkpointed(signed.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("parity").alias("parity")))
    posts = reps.select("rep", F.explode("keys").alias("key"))
    common = posts.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1")
    shared = posts.join(common, posts.key == common._key).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("lists"), F.sum("n").alias("central"))
    # Coordinates met nowhere else come first in the order of rarity, and need no list.
    length = F.size("lists") - (matches - 1)
    prefix = shared.where(length > 0).select("rep", "central", F.explode(F.slice("lists", F.lit(1), length)).alias("l")).select("rep", "central", "l.key")
    several = prefix.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1")
    prefix = checkpointed(prefix.join(several, prefix.key == several._key).select("rep", "central", "key"))
    involved = prefix.select(F.col("rep").alias("_id")).distinct()
    packed = compressed(documents)
    held = checkpointed(packed.join(involved, packed.doc_id == involved._id, "left_semi"))

    # One byte of each coordinate's key is enough to count collisions that are then confirmed.
    sig = reps.select("rep", "n", F.transform("keys", lambda k: k.bitwiseAND(F.lit(127)).cast("byte")).alias("bytes"), "parity")
    first = Window.partitionBy("key").orderBy(F.desc("central"), "rep")
    pivots = prefix.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= PIVOTS).select(F.col("key").alias("_key"), F.col("rep").alias("a"))
    star = prefix.join(pivots, prefix.key == pivots._key).where("a <> rep").select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
    star = star.join(sig.withColumnsRenamed({"rep": "a", "n": "na", "bytes": "ka", "parity": "pa"}), "a").join(sig.withColumnsRenamed({"rep": "b", "n": "nb", "bytes": "kb", "parity": "pb"}), "b")
    alike = F.aggregate(F.zip_with("ka", "kb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & ((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb")))
    links = checkpointed(confirmed(star.where(fits & (alike >= matches)).select("a", "b"), held, words, percent))
    joined = components(links)

    placed = prefix.join(joined, prefix.rep == joined.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy(F.col("key").alias("_key")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    mixed = mixed.select("_key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    open_ = placed.join(mixed, placed.key == mixed._key).drop("_key").join(sig.withColumnRenamed("rep", "_rep"), F.col("rep") == F.col("_rep")).drop("_rep")
    open_ = open_.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", "n", "bytes", "parity")

    def merge(i, j, rep, component, own, n, seen, parity):
        """Pairs (a, b) of one list, whose rows are in the order of size."""
        most = seen.shape[1] * 8 - (-coordinates % 8) - matches  # coordinates that may differ
        seventh, top_bit = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
        out_a, out_b = [], []
        step, tile, half = 128, 2048, (seen.shape[1] + 1) // 2
        for s in range(0, len(rep), step):  # rows in the order of size, each against the next larger ones
            e = min(s + step, len(rep))
            top = int(np.searchsorted(n, 100 * n[e - 1] // percent, "right"))
            for t in range(s, top, tile):
                z = min(t + tile, top)
                wanted = (component[s:e, None] != component[None, t:z]) & (percent * n[None, t:z] <= 100 * n[s:e, None])
                if t < e:
                    wanted &= np.arange(s, e)[:, None] < np.arange(t, z)[None, :]
                if i != j:
                    wanted &= own[s:e, None] != own[None, t:z]
                if not wanted.any():
                    continue
                # half of the coordinates rule most pairs out
                off = np.zeros(wanted.shape, np.uint8)
                for k in range(half):
                    off += np.bitwise_count(((seen[s:e, None, k] ^ seen[None, t:z, k]) + seventh) & top_bit)
                x, y = np.nonzero(wanted & (off <= most))
                x, y = x + s, y + t
                differ = np.bitwise_count(((seen[x] ^ seen[y]) + seventh) & top_bit).sum(axis=1)
                x, y = x[differ <= most], y[differ <= most]
                apart = np.bitwise_count(parity[x] ^ parity[y]).sum(axis=1, dtype=np.int64)
                good = (100 + percent) * apart <= (100 - percent) * (n[x] + n[y])
                out_a.append(np.minimum(rep[x[good]], rep[y[good]]))
                out_b.append(np.maximum(rep[x[good]], rep[y[good]]))
        a, b = (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return a, b

    def lists(batches):
        """Lists are many and mostly short: they are cut from sorted batches, the last one carried on."""
        import pyarrow as pa

        def pairs(columns):
            key, i, j = columns[:3]
            head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            found = [merge(int(i[s]), int(j[s]), *[c[s:e] for c in columns[3:]]) for s, e in zip(head, np.r_[head[1:], len(key)]) if e - s > 1]
            a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])

        held = None
        for batch in batches:
            if not len(batch):
                continue
            flat = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "rep", "component", "own", "n")]
            seen = batch.column("bytes").flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(len(batch), -1)  # values below 128
            seen = np.ascontiguousarray(np.pad(seen, ((0, 0), (0, -coordinates % 8)))).view(np.uint64)
            parity = np.ascontiguousarray(batch.column("parity").flatten().to_numpy(zero_copy_only=False)).view(np.uint64).reshape(len(batch), -1)
            held = [np.concatenate(x) for x in zip(held, [*flat, seen, parity])] if held else [*flat, seen, parity]
            key, i, j = held[:3]
            cut = int(np.flatnonzero((key == key[-1]) & (i == i[-1]) & (j == j[-1]))[0])
            if cut:
                yield pairs([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held:
            yield pairs(held)

    # Small in bytes and long in time: not to be dealt to fewer tasks than there are partitions.
    wide = 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crossing = open_.repartition(wide, "key", "i", "j").sortWithinPartitions("key", "i", "j", "n").mapInArrow(given_back(lists), "a long, b long").distinct()
    more = confirmed(crossing, held, words, percent)
    final = components(links.unionByName(more))
    known = reps.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "rep").join(final, F.col("rep") == F.col("node"), "left")
    known = known.select("_h1", "_h2", F.coalesce("component", "rep").alias("component"))
    out = signed.drop("keys", "parity").withColumn("has", (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    out = out.join(known, F.col("has") & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
