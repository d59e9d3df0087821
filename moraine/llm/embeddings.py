"""Near-duplicate vectors by randomised-rotation binary codes, and exact top-k inner products.

Near duplicates: equal vectors are collapsed to one representative with a multiplicity.  Each
representative gets a stored code: the signs of its randomly rotated coordinates, one bit each; the
correction factor, which is the inner product of the rotated vector and its code; the rotated vector in
16 levels a coordinate, with the length of what the levels lose; and its keys.  Codes, not vectors, are
posted under the short random-hyperplane keys of several tables, and codes that meet are compared:
``<code, q> / factor`` is an unbiased estimate of the cosine, off by at most ``k`` standard deviations
with high confidence.  Pairs whose upper bound is below the threshold are dropped; only for pairs above
it are the vectors fetched, and every link is recomputed in double precision.  Buckets of any size are
cut into blocks, and pairs of blocks are separate tasks.  The number of keys follows from the number of
vectors and the wanted recall at the threshold.

Top-k: candidates are packed into blocks, each with an impact-ordered index: the postings (row,
coordinate) grouped into segments of one coordinate, sign and quantised impact, in descending order of
impact.  For a block of queries, segments are added to the scores in that order, many at a time, until every row
that can still be among the best is known by proof (its upper bound reaches the k-th best lower bound);
those rows are rescored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.common import checkpointed, components

_BLOCK = 1500


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components present and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


@lru_cache(maxsize=8)
def rotation(d: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def plan_keys(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a key, and key tables, for ``n`` vectors: buckets of a few hundred unrelated vectors,
    and a pair at the threshold missed with probability ``miss`` at most."""
    bits = int(min(20, max(2, round(math.log2(max(n, 1) / 200 + 1)))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


@dataclass
class Codes:
    """Codes of vectors of one length: signs (packed bits), correction factors, the rotated vectors'
    levels (two to a byte) with their step, and the length of what the levels lose."""

    d: int
    signs: np.ndarray
    factor: np.ndarray
    levels: np.ndarray
    step: np.ndarray
    lost: np.ndarray

    @classmethod
    def of(cls, unit: np.ndarray, turn: np.ndarray) -> Codes:
        d = unit.shape[1]
        turned = unit @ turn
        factor = np.abs(turned).sum(axis=1) / math.sqrt(d)  # the code is scaled to unit length
        step = np.maximum(np.abs(turned).max(axis=1), 1e-12) / 7.5
        level = np.clip(np.floor(turned / step[:, None]) + 8, 0, 15).astype(np.uint8)
        lost = np.linalg.norm(turned - (level - 7.5) * step[:, None], axis=1)
        level = np.pad(level, ((0, 0), (0, d % 2)))
        return cls(d, np.packbits(turned >= 0, axis=1), factor.astype(np.float32), level[:, ::2] << 4 | level[:, 1::2], step.astype(np.float32), lost.astype(np.float32))

    def blobs(self) -> list[bytes]:
        numbers = np.stack([self.factor, self.step, self.lost], axis=1)
        return [n.tobytes() + s.tobytes() + v.tobytes() for n, s, v in zip(numbers, self.signs, self.levels)]

    @classmethod
    def read(cls, blobs: list[bytes], d: int) -> Codes:
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1)
        numbers, ends = np.ascontiguousarray(raw[:, :12]).view(np.float32), 12 + (d + 7) // 8
        return cls(d, raw[:, 12:ends], numbers[:, 0], raw[:, ends:], numbers[:, 1], numbers[:, 2])

    def take(self, rows: np.ndarray) -> Codes:
        return Codes(self.d, self.signs[rows], self.factor[rows], self.levels[rows], self.step[rows], self.lost[rows])

    def code(self) -> np.ndarray:
        bits = np.unpackbits(self.signs, axis=1, count=self.d).astype(np.float32)
        return (2 * bits - 1) / np.float32(math.sqrt(self.d))

    def rotated(self) -> np.ndarray:
        level = np.stack([self.levels >> 4, self.levels & 15], axis=2).reshape(len(self.levels), -1)[:, : self.d]
        return (level - np.float32(7.5)) * self.step[:, None]


def possible_pairs(a: Codes, b: Codes, same: bool, threshold: float, sure: float = 4.5) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of a, j of b) whose upper bound of the cosine reaches the threshold: all but
    those that the estimate rules out by ``sure`` standard deviations."""
    factor = np.maximum(a.factor, 1e-6)
    estimate = (a.code() @ b.rotated().T) / factor[:, None]
    # The part of q across the vector has length sqrt(1 - cos^2) and any direction; so has what q's levels lost.
    own = np.sqrt(np.maximum(1 - a.factor**2, 0)) / factor / math.sqrt(max(a.d - 1, 1)) * math.sqrt(1 - threshold**2)
    off = np.sqrt(own[:, None] ** 2 + (b.lost[None, :] / factor[:, None]) ** 2 / max(a.d - 1, 1))
    maybe = estimate + sure * off + 1e-5 >= threshold
    if same:
        maybe &= np.arange(len(a.factor))[:, None] < np.arange(len(b.factor))[None, :]
    return np.nonzero(maybe)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
        if not len(i) and (label == label[label]).all():
            break
    while (label != label[label]).any():
        label = label[label]
    return label


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of large components would overflow, of small ones vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, miss: float = 1e-3, seed: int = 7, block: int = _BLOCK) -> DataFrame:
    """One row per row of ``vectors`` (``vec_id``, ``embedding``; other columns are ignored):
    ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as
    do rows without an id.  Vectors of different length are not compared.  Rows of one id are one
    node of the link graph.  An empty table gives an empty result.
    """
    rows = vectors.select("vec_id", "embedding")
    takes_part = usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("_in", takes_part).withColumn("h1", F.when(F.col("_in"), F.xxhash64("embedding"))).withColumn("h2", F.when(F.col("_in"), F.xxhash64(F.lit(seed), "embedding")))
    classes = checkpointed(rows.where("_in").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")))
    n = classes.count()
    bits, tables = plan_keys(n, threshold, miss)

    narrow = np.uint8 if bits <= 8 else np.int32

    def coded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for part in parts:
            for d, own in part.groupby(part["embedding"].map(len)):
                unit = _unit(own["embedding"])
                if d not in planes:
                    planes[d] = np.random.default_rng([seed + 1, d]).standard_normal((d, bits * tables))
                above = (unit @ planes[d] >= 0).reshape(len(unit), tables, bits)
                keys = above @ (1 << np.arange(bits)).astype(np.int32)
                code = [k.tobytes() + c for k, c in zip(keys.astype(narrow), Codes.of(unit, rotation(d, seed)).blobs())]
                yield pd.DataFrame({"rep": own["rep"].to_numpy(), "d": d, "keys": list(keys), "code": code})

    codes = checkpointed(classes.select("rep", "embedding").mapInPandas(coded, "rep long, d int, keys array<int>, code binary"))
    crowded = codes.select("d", F.posexplode("keys").alias("t", "key")).groupBy("t", "d", "key").agg(F.count("*").alias("c")).where("c > 1")
    crowded = crowded.select(F.col("t").alias("_t"), F.col("d").alias("_d"), F.col("key").alias("_key"), F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    posted = codes.select("rep", "d", "code", F.posexplode("keys").alias("t", "key"))
    posted = posted.join(crowded, (F.col("t") == F.col("_t")) & (F.col("d") == F.col("_d")) & (F.col("key") == F.col("_key"))).drop("_t", "_d", "_key")
    posted = posted.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    posted = posted.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        t, d, i, j = (int(group[c].iloc[0]) for c in ("t", "d", "i", "j"))
        group = group.sort_values("rep")
        wide = tables * np.dtype(narrow).itemsize
        keys = np.frombuffer(b"".join(c[:wide] for c in group["code"]), narrow).reshape(len(group), tables)
        code, own, rep = Codes.read([c[wide:] for c in group["code"]], d), group["own"].to_numpy(), group["rep"].to_numpy()
        if i == j:
            a, b = possible_pairs(code, code, True, threshold)
        else:
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            a, b = possible_pairs(code.take(left), code.take(right), False, threshold)
            a, b = left[a], right[b]
        if t and len(a):  # a pair counts in the first table that brings it together
            first = ~(keys[a, :t] == keys[b, :t]).any(axis=1)
            a, b = a[first], b[first]
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        pairs = zstandard.compress(place.astype(np.int32).tobytes(), 1)
        return pd.DataFrame([(t, d, int(group["key"].iloc[0]), i, j, rep[used].tolist(), pairs)] if len(a) else [], columns=["t", "d", "key", "i", "j", "reps", "pairs"])

    place = ["t", "d", "key", "i", "j"]
    maybe = checkpointed(posted.groupBy(*place).applyInPandas(compare, "t int, d int, key int, i int, j int, reps array<long>, pairs binary"))
    # The vectors of undecided pairs go to the task that has the pairs.
    asked = maybe.select(*place, F.posexplode("reps").alias("at", "asked"), F.when(F.col("at") == 0, F.col("pairs")).alias("pairs"))
    fetched = asked.join(classes.select("rep", "n", "embedding"), F.col("asked") == F.col("rep")).drop("asked")

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        unit, n, rep = _unit(group["embedding"]), group["n"].to_numpy(), group["rep"].to_numpy()
        a, b = np.frombuffer(zstandard.decompress(group["pairs"].iloc[0]), np.int32).reshape(2, -1)
        good = np.concatenate([np.einsum("ij,ij->i", unit[a[s : s + 100_000]], unit[b[s : s + 100_000]]) >= threshold for s in range(0, len(a), 100_000)])
        a, b = a[good], b[good]
        links = np.bincount(a, n[b], len(rep)) + np.bincount(b, n[a], len(rep))
        some = links > 0
        return pd.DataFrame({"rep": rep[some], "links": links[some].astype(np.int64), "root": rep[_roots(len(rep), a, b)][some]})

    found = checkpointed(fetched.groupBy(*place).applyInPandas(decide, "rep long, links long, root long"))
    links = found.groupBy(F.col("rep").alias("_rep")).agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct())
    known = classes.select("h1", "h2", "rep", "n")
    known = known.join(links, known.rep == links._rep, "left").join(joined, known.rep == joined.node, "left")
    known = known.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    out = rows.select("vec_id", "h1", "h2").join(known, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


class Index:
    """The postings of a block of vectors (of whole numbers): row numbers by segment, the segments in
    descending order of impact.  A posting's impact is its size in steps of ``width``; those below one
    step have none."""

    def __init__(self, x: np.ndarray, levels: int = 127):
        size = np.abs(x)
        self.width = max(1.0, math.ceil((float(size.max(initial=0)) + 1) / levels))
        self.level = np.floor(size / self.width).astype(np.int8)
        row, coordinate = np.nonzero(self.level)
        impact, minus = self.level[row, coordinate].astype(np.int64), x[row, coordinate] < 0
        segment = ((levels + 1 - impact) * x.shape[1] + coordinate) * 2 + minus
        order = np.argsort(segment, kind="stable")
        self.rows, segment = row[order].astype(np.int32), segment[order]
        self.heads = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else np.zeros(0, np.int64)
        of = segment[self.heads]
        self.impact, self.coordinate, self.sign = levels + 1 - of // (2 * x.shape[1]), of // 2 % x.shape[1], 1.0 - 2.0 * (of % 2)
        self.cuts = np.r_[self.heads, len(self.rows)]

    def postings(self, first: int, last: int, shape: tuple[int, int]) -> np.ndarray:
        """The signed impacts of the segments from ``first`` to before ``last``, laid out as a matrix: one
        product adds all these segments to the scores of many queries."""
        out = np.zeros(shape)
        many = np.diff(self.cuts[first : last + 1])
        value = self.sign[first:last] * self.impact[first:last] * self.width
        out[self.rows[self.cuts[first] : self.cuts[last]], np.repeat(self.coordinate[first:last], many)] = np.repeat(value, many)
        return out


def best_in_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, index: Index | None = None):
    """(query index, row index, score) of each query's ``k`` best rows, ties to the smaller id;
    rows with the query's own id are left out."""
    index = index or Index(x)
    score, size = np.zeros((len(q), len(x))), np.abs(q)
    other = q_ids[:, None] != x_ids[None, :]
    k, at, top = min(k, len(x)), 0, int(index.impact.max(initial=0))
    for least in sorted({max(1, top // 2), max(1, top // 6), 1}, reverse=True):
        to = int(np.searchsorted(-index.impact, -least, "right"))  # the next segments in the order of impact
        score += q @ index.postings(at, to, x.shape).T
        at = to
        # What is missing of a posting that was added is below a step, of another below ``least`` steps.
        rest = ((index.width - 1) * size.sum(axis=1))[:, None] + (least - 1) * index.width * (size @ (index.level < least).T)
        slack = 1e-9 * (float(np.abs(score).max(initial=0)) + float(rest.max(initial=0)))
        low = np.where(other, score - rest, -np.inf)
        reach = np.partition(low, len(x) - k, axis=1)[:, len(x) - k]
        possible = (score + rest >= reach[:, None] - slack) & other
        if possible.sum() <= 4 * k * len(q):
            break
    i, j = np.nonzero(possible)
    exact = np.empty(len(i))
    for s in range(0, len(i), 100_000):
        exact[s : s + 100_000] = np.einsum("ij,ij->i", q[i[s : s + 100_000]], x[j[s : s + 100_000]])
    order = np.lexsort((x_ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < k
    return i[keep], j[keep], exact[keep]


def _scaled(part: pd.DataFrame, scale: float) -> np.ndarray:
    return np.floor(scale * np.stack(part["embedding"].to_numpy()).astype(np.float64))


def packed(vectors: DataFrame, scale: float, rows: int) -> DataFrame:
    """Blocks of up to ``rows`` vectors: ``d``, ``ids``, ``matrix`` (little-endian doubles)."""

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}

        def block(own: pd.DataFrame, d: int) -> pd.DataFrame:
            return pd.DataFrame({"d": [d], "ids": [own["vec_id"].to_numpy(np.int64).tobytes()], "matrix": [_scaled(own, scale).tobytes()]})

        for part in parts:
            for d, own in part.groupby(part["embedding"].map(len)):
                held.setdefault(d, []).append(own)
                if sum(map(len, held[d])) >= rows:
                    every = pd.concat(held.pop(d))
                    whole = len(every) // rows * rows
                    for s in range(0, whole, rows):
                        yield block(every.iloc[s : s + rows], d)
                    if whole < len(every):
                        held[d] = [every.iloc[whole:]]
        for d, own in held.items():
            yield block(pd.concat(own), d)

    return vectors.mapInPandas(pack, "d int, ids binary, matrix binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, query_rows: int = 512, rows: int = 4096, lanes: int | None = None) -> DataFrame:
    """Each query's ``k`` rows of largest inner product of ``floor(scale * x)``: ``query_id``,
    ``rank``, ``vec_id``, ``score``.

    Rows without an id, and unusable vectors (see :func:`usable`), take no part; vectors of different
    length are not compared; scores are exact while they stay below 2^53, and end at the range of a long.  The queries are a stated
    set: their blocks are sent to ``lanes`` groups of candidate blocks, and each group streams through
    pairs of blocks, so a task holds two blocks and their scores only.
    """
    good = vectors.select("vec_id", "embedding").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    spark = vectors.sparkSession
    lanes = lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = packed(good, scale, rows).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    queries = packed(good.where(is_query), scale, query_rows).select(F.col("d").alias("q_d"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("q_lane"))
    pairs = candidates.join(queries, (F.col("lane") == F.col("q_lane")) & (F.col("d") == F.col("q_d"))).select("d", "ids", "matrix", "q_ids", "q_matrix")

    def search(batches):
        import pyarrow as pa

        held, index = None, None  # a block's index serves the query blocks that follow
        most = float(2**63 - 1024)
        for batch in batches:
            for at in range(len(batch)):
                d, ids, matrix, q_ids, q_matrix = (c[at].as_py() for c in batch.columns)
                x, q = np.frombuffer(matrix).reshape(-1, d), np.frombuffer(q_matrix).reshape(-1, d)
                if index is None or matrix != held:
                    held, index = matrix, Index(x)
                x_ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                i, j, score = best_in_block(q, q_ids, x, x_ids, k, index)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(x_ids[j]), pa.array(np.clip(score, -most, most).astype(np.int64))], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
