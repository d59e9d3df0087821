"""Removal of passages repeated from earlier documents, by suffix arrays.

Suffix arrays are built in linear time by grouping.  Suffixes start in groups of equal first symbol;
groups are processed in descending order, and the suffixes that the pointers to the previous
smaller suffix lead to are moved out of their groups, ordered by how many pointers lead to them, until
every group shares one Lyndon prefix.  A second pass emits the order within groups from the smaller
suffixes on, along the same pointers.  No symbols are renamed and nothing recurs.

To spread the work, every window of ``length`` bytes belongs to an anchor, the leftmost byte gram of
smallest hash in it; equal windows have equal anchors.  The runs of windows that share an anchor are
its contexts.  Anchors of one document only are settled by an exchange of hashes; the contexts of the
others go to the anchor's bucket, where equal contexts are collapsed to one with its smallest document
(and an anchor left with one context has nothing to sort), and a suffix array over the contexts' symbols (a symbol is a byte gram of ``length - STEP``) brings
equal windows together: suffixes that share STEP + 1 symbols follow each other in its order, and those that
follow each other are compared by their bytes.  Hashes only route and order; bytes decide what is equal,
where contexts are collapsed too.

Texts travel as compressed packs of documents.  The same documents must make the same packs in every
pass (as they do when read from files); a pack that does not come back is an error.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; documents of one id do
not remove each other's bytes; rows without an id neither lose nor remove; documents of any length are
one pack at least; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import checkpointed, released
from moraine.llm.shingles import buffers, mix, powers

GRAM, STEP = 20, 4
PACK = 2 << 20
#: Symbols of one suffix array: small enough for the processor's caches; an anchor is never cut.
SLICE = 6_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers, kept for the next call unless they are many."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = powers(base, max(n, PACK + (PACK >> 2)))
        if n <= 2 * PACK:
            _POWERS[int(base)] = held
    return held[:n]


def _squeeze(values: np.ndarray, steps: bool = False) -> bytes:
    """Integers by byte planes, compressed; ``steps`` stores the differences of ordered ones."""
    if steps and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), 1)


def _expand(raw: bytes, kind, steps: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if steps else values


def suffix_array(symbols: list[int]) -> list[int]:
    """The suffix array of a sequence of integers (its end counts as smaller than any)."""
    n = len(symbols)
    if not n:
        return []
    # Groups are named by their first place in the order; -1 ends the chain of groups.
    at: dict[int, list[int]] = {}
    for i, x in enumerate(symbols):
        if x in at:
            at[x].append(i)
        else:
            at[x] = [i]
    group, size, below, members = [0] * n, [0] * (n + 1), [-1] * (n + 1), [None] * (n + 1)
    place, last = 0, -1
    for x in sorted(at):
        own = at[x]
        for i in own:
            group[i] = place
        size[place], below[place], members[place] = len(own), last, own
        last, place = place, place + len(own)
    previous = [-1] * n
    g = last
    while g >= 0:
        own = members[g]
        members[g] = None
        if size[g] != len(own):
            own = [i for i in own if group[i] == g]
        if len(own) == 1:  # a single suffix moves its predecessor, unless that is alone already
            j = own[0] - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[own[0]] = j
            if j >= 0:
                h = group[j]
                k = size[h]
                if k > 1:
                    new = h + k - 1
                    size[h], size[new], members[new], group[j] = k - 1, 1, [j], new
                    below[h + k], below[new] = new, h
        else:
            own.sort()
            pointed: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = previous[j]
                previous[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by_count: dict[int, list[int]] = {}
            for j, times in pointed.items():
                by_count.setdefault(times, []).append(j)
            for times in sorted(by_count, reverse=True):
                moved: dict[int, list[int]] = {}
                for j in by_count[times]:
                    moved.setdefault(group[j], []).append(j)
                for h, some in moved.items():
                    k, m = size[h], len(some)
                    if m < k:
                        new = h + k - m
                        size[h], size[new], members[new] = k - m, m, some
                        below[h + k], below[new] = new, h
                        for j in some:
                            group[j] = new
        g = below[g]
    order, free, done = [0] * n, list(range(n)), [False] * n
    j, k = n - 1, 0  # the empty suffix comes first
    while True:
        while j >= 0 and not done[j]:
            h = group[j]
            p = free[h]
            order[p] = j
            free[h] = p + 1
            done[j] = True
            j = previous[j]
        if k == n:
            return order
        j = order[k] - 1
        k += 1


class Hashes:
    """Hashes of all byte grams of a text, from running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, n), out=self.sums[1:])
        self.back = _powers(_BACK, n + 1)

    def grams(self, size: int) -> np.ndarray:
        n = max(len(self.sums) - size, 0)
        return mix((self.sums[size:] - self.sums[:n]) * self.back[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def contexts(data: np.ndarray, offsets: np.ndarray, length: int):
    """(anchor hash, start, end, row) of each run of windows with one anchor, and the hashes."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < length:
        return none, None
    hashes = Hashes(data)
    value, where, span = hashes.grams(GRAM), None, 1
    own, width = value, length - GRAM + 1
    where = np.arange(len(value), dtype=np.int32)
    while span < width:
        step = min(span, width - span)
        less = value[step:] < value[:-step]
        where = np.where(less, where[step:], where[:-step])
        value = np.where(less, value[step:], value[:-step])
        span += step
    start = np.arange(len(data) - length + 1)
    row = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[row + 1]
    start, row, anchor = start[inside], row[inside], where[: len(inside)][inside]
    if not len(start):
        return none, hashes
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(start) - 1]
    return (own[anchor[first]], start[first], start[last] + length, row[first]), hashes


def _packs(batches, size: int):
    """(key, ids, bytes, offsets) of packs of consecutive documents with an id; the key is a hash of
    the pack's ids, lengths and bytes."""
    ids, lengths, parts, total = [], [], [], 0

    def close():
        i, n, data = np.concatenate(ids), np.concatenate(lengths), np.concatenate(parts)
        digest = hashlib.blake2b(i.tobytes() + n.tobytes(), digest_size=8)
        digest.update(data)
        return int.from_bytes(digest.digest(), "little", signed=True), i, data, np.r_[0, np.cumsum(n)]

    for batch in batches:
        batch = batch.filter(batch.column("doc_id").is_valid())
        data, offsets = buffers(batch.column("text"))
        doc = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(doc):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max(size - total, 1), "right")) - 1)
            ids.append(doc[at:to])
            lengths.append(np.diff(offsets[at : to + 1]))
            parts.append(data[offsets[at] : offsets[to]])
            total += int(offsets[to] - offsets[at])
            at = to
            if total >= size:
                yield close()
                ids, lengths, parts, total = [], [], [], 0
    if ids:
        yield close()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _by_bucket(h: np.ndarray, buckets: int):
    """The distinct anchors in the order of bucket and hash, the buckets that have any, the cuts between
    them, and each row's place."""
    bucket = (h >> np.uint64(40)) % np.uint64(buckets)
    short = (bucket << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))
    distinct, place = np.unique(short, return_inverse=True)
    filled, first = np.unique(distinct >> np.uint64(40), return_index=True)
    return distinct, filled.astype(np.int64), np.r_[first, len(distinct)], place


def _words(data: np.ndarray) -> np.ndarray:
    """The 64-bit word that starts at each byte."""
    return np.lib.stride_tricks.as_strided(np.frombuffer(data.tobytes() + bytes(8), np.uint64, 1), (len(data) + 1,), (1,))


def _same_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes (8 or more) at ``a`` and at ``b`` are equal."""
    same = np.ones(len(a), bool)
    for at in [*range(0, length - 8, 8), length - 8]:
        left = np.flatnonzero(same)
        same[left] = words[a[left] + at] == words[b[left] + at]
    return same


def window_minima(anchor: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For distinct contexts ``data[begin:end]`` of one or more anchors (ordered by anchor) and their
    smallest documents: for each window in order, the smallest document that has it."""
    size, step = end - begin, STEP
    grams = length - step
    n_symbols = size - grams + 1
    at = np.repeat(begin, n_symbols) + np.arange(int(n_symbols.sum())) - np.repeat(np.cumsum(n_symbols) - n_symbols, n_symbols)
    hashed, words = Hashes(data).grams(grams)[at], _words(data)
    windows = size - length + 1
    out_at = np.cumsum(windows) - windows
    result = np.empty(int(windows.sum()), np.int64)
    cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])  # slices hold whole anchors
    first_symbol = np.cumsum(n_symbols) - n_symbols
    lead = first_symbol[cuts] // SLICE
    slices = np.r_[cuts[np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])], len(anchor)]
    for a, b in zip(slices[:-1], slices[1:]):
        own = slice(int(first_symbol[a]), int(first_symbol[b - 1] + n_symbols[b - 1]))
        _, symbol = np.unique(hashed[own], return_inverse=True)
        count = n_symbols[a:b]
        text = np.zeros(len(symbol) + b - a, np.int64)  # 0 ends each context
        place = np.arange(len(symbol)) + np.repeat(np.arange(b - a), count)
        text[place] = symbol + 1
        order = np.array(suffix_array(text.tolist()), np.int64)
        which = np.searchsorted(np.cumsum(count + 1), order, "right")
        inner = order - (np.cumsum(count + 1) - count - 1)[which]
        keep = inner < windows[a:b][which]
        order, which, inner = order[keep], which[keep], inner[keep]
        where = begin[a:b][which] + inner
        head = np.flatnonzero(np.r_[True, ~_same_bytes(words, where[1:], where[:-1], length)])
        low = np.minimum.reduceat(doc[a:b][which], head)
        result[out_at[a:b][which] + inner] = np.repeat(low, np.diff(np.r_[head, len(order)]))
    return result


def _covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of intervals that overlap or touch."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    head = np.flatnonzero(new)
    return starts[head], reach[np.r_[head[1:] - 1, len(starts) - 1]] if len(head) else reach


def repeated(documents: DataFrame, length: int = 50, buckets: int | None = None, pack: int = PACK) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``starts``, ``ends`` (the
    removed runs, in bytes) of each row of ``documents`` (``doc_id``, ``text``)."""
    documents = documents.select("doc_id", "text")
    id_type = dict(documents.dtypes)["doc_id"]
    if buckets is None:
        total = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = int(max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (12 << 20)))

    def announce(batches):
        for key, ids, data, offsets in _packs(batches, pack):
            (h, _, _, row), _ = contexts(data, offsets, length)
            distinct, filled, cuts, place = _by_bucket(h, buckets)
            low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), np.iinfo(np.int64).min)
            np.minimum.at(low, place, ids[row])
            np.maximum.at(high, place, ids[row])
            several = low < high
            # A pack without anchors announces itself all the same: it has to come back.
            rows = [(b, key, _squeeze(distinct[p:q], True), _bits(several[p:q])) for b, p, q in zip(filled.tolist() or [0], cuts[:-1] if len(filled) else [0], cuts[1:] if len(filled) else [0])]
            yield pa_batch(rows, ["bucket", "pack", "anchors", "several"], ["int32", "int64", "binary", "binary"])

    def shared(group: pd.DataFrame) -> pd.DataFrame:
        every = [_expand(x, np.uint64, True) for x in group["anchors"]]
        distinct, place = np.unique(np.concatenate(every), return_inverse=True)
        times = np.bincount(place, minlength=len(distinct))
        at = 0
        for x, raw in zip(every, group["several"]):
            times[place[at : at + len(x)][_flags(raw, len(x))]] += 1
            at += len(x)
        answers, at = [], 0
        for x in every:
            answers.append(_bits(times[place[at : at + len(x)]] > 1))
            at += len(x)
        return pd.DataFrame({"pack": group["pack"], "bucket": group["bucket"], "bits": answers})

    def packed(batches):
        press = zstandard.ZstdCompressor(level=1)
        for key, ids, data, offsets in _packs(batches, pack):
            yield pa_batch([(key, ids.tobytes(), offsets.astype(np.int64).tobytes(), press.compress(data.tobytes()))], ["pack", "ids", "offsets", "data"], ["int64", "binary", "binary", "binary"])

    def unpacked(row):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8) if row["data"] else np.zeros(0, np.uint8)
        return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["offsets"], np.int64), data

    def send(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for row in batch.to_pylist():
                if row["answers"] is None:
                    raise RuntimeError("the packs of documents differ between passes; write the documents to a table first")
                ids, offsets, data = unpacked(row)
                (h, start, end, of), hashes = contexts(data, offsets, length)
                distinct, filled, cuts, place = _by_bucket(h, buckets)
                flag, number = np.zeros(len(distinct), bool), {b: k for k, b in enumerate(filled.tolist())}
                for a in row["answers"]:
                    if a["bucket"] in number:
                        p, q = cuts[number[a["bucket"]]], cuts[number[a["bucket"]] + 1]
                        flag[p:q] = _flags(a["bits"], q - p)
                own = np.flatnonzero(flag[place])
                if not len(own):
                    continue
                own = own[np.argsort(place[own], kind="stable")]
                span = hashes.spans(start[own], end[own])
                bound = np.searchsorted(place[own], cuts)
                rows = []
                for b, p, q in zip(filled.tolist(), bound[:-1], bound[1:]):
                    if p == q:
                        continue
                    o = own[p:q]
                    _, once, which = np.unique(span[p:q], return_index=True, return_inverse=True)
                    size = (end - start)[o[once]]
                    at = np.repeat(start[o[once]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    rows.append((b, row["pack"], _squeeze(distinct[place[o]], True), span[p:q][once].tobytes(), _squeeze(which.astype(np.int32)), _squeeze(size.astype(np.int32)), press.compress(data[at].tobytes()), _squeeze(of[o].astype(np.int32)), _squeeze(ids[of[o]]), _squeeze((start[o] - offsets[of[o]]).astype(np.int64))))
                yield pa_batch(rows, _SENT, ["int32", "int64", *["binary"] * 8])

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        read = lambda name, kind, steps=False: [_expand(x, kind, steps) for x in group[name]]
        spans = [np.frombuffer(x, np.uint64) for x in group["spans"]]
        anchors, which, sizes = read("anchors", np.uint64, True), read("which", np.int32), read("sizes", np.int32)
        rows, docs, starts = read("rows", np.int32), read("docs", np.int64), read("starts", np.int64)
        texts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for x in group["texts"]]
        span = np.concatenate([s[w] for s, w in zip(spans, which)])
        anchor, doc, start = np.concatenate(anchors), np.concatenate(docs), np.concatenate(starts)
        data = np.concatenate(texts)
        size_of, base = np.concatenate(sizes).astype(np.int64), np.cumsum([0, *map(len, sizes)])
        begin_of = np.cumsum(size_of) - size_of
        local = np.concatenate([w.astype(np.int64) + b for w, b in zip(which, base)])
        # equal contexts become one with its smallest document
        order = np.lexsort((span, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (span[order[1:]] != span[order[:-1]])
        # (those that one pack sent once are the same bytes; others of one hash are compared)
        met = np.flatnonzero(~new)
        x, y = local[order[met]], local[order[met - 1]]
        met, x, y = met[x != y], x[x != y], y[x != y]
        differ, words = size_of[x] != size_of[y], _words(data)
        for n in np.unique(size_of[x[~differ]]):
            some = np.flatnonzero(~differ & (size_of[x] == n))
            differ[some] = ~_same_bytes(words, begin_of[x[some]], begin_of[y[some]], int(n))
        new[met[differ]] = True
        head = np.flatnonzero(new)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        low = np.minimum.reduceat(doc[order], head)
        chosen = local[order[head]]
        windows = size_of[chosen] - length + 1
        first = np.cumsum(windows) - windows
        minima = np.repeat(low, windows)
        # an anchor with one context has nothing to sort: all its windows are that context's
        met = anchor[order[head]]
        alone = np.ones(len(met), bool)
        alone[1:] &= met[1:] != met[:-1]
        alone[:-1] &= met[1:] != met[:-1]
        sort = np.flatnonzero(~alone)
        if len(sort):
            size = size_of[chosen[sort]]
            end = np.cumsum(size)
            at = np.repeat(begin_of[chosen[sort]] - (end - size), size) + np.arange(int(end[-1]))
            minima[np.repeat(~alone, windows)] = window_minima(met[sort], end - size, end, data[at], low[sort], length)
        del data, words
        out, packs, at = [], group["pack"].to_numpy(), 0
        for k, own_rows in enumerate(rows):
            n = len(own_rows)
            num = number[at : at + n]
            w = windows[num]
            every = np.repeat(first[num] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
            of = np.repeat(np.arange(n), w)
            gone = minima[every] < doc[at : at + n][of]
            inner = np.arange(len(of)) - np.repeat(np.cumsum(w) - w, w)
            i = np.flatnonzero(gone)
            if len(i):
                head_i = np.ones(len(i), bool)
                head_i[1:] = (i[1:] != i[:-1] + 1) | (of[i[1:]] != of[i[:-1]])
                a = i[head_i]
                z = i[np.r_[np.flatnonzero(head_i)[1:] - 1, len(i) - 1]]
                s = start[at : at + n][of[a]]
                blob = np.stack([own_rows[of[a]].astype(np.int64), s + inner[a], s + inner[z] + length])
                out.append((int(packs[k]), zstandard.compress(np.ascontiguousarray(blob).tobytes(), 1)))
            at += n
        return pd.DataFrame(out, columns=["pack", "gone"])

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, data = unpacked(row)
                blobs = [np.frombuffer(zstandard.decompress(x), np.int64).reshape(3, -1) for x in row["gone"] or []]
                gone = np.concatenate(blobs, axis=1) if blobs else np.zeros((3, 0), np.int64)
                gone = gone[:, np.argsort(gone[0], kind="stable")]
                cut = np.searchsorted(gone[0], np.arange(len(ids) + 1))
                out = []
                for k, doc in enumerate(ids.tolist()):
                    text = data[offsets[k] : offsets[k + 1]]
                    s, e = _covered(gone[1, cut[k] : cut[k + 1]], gone[2, cut[k] : cut[k + 1]]) if cut[k] < cut[k + 1] else (gone[1, :0], gone[2, :0])
                    edges = np.r_[0, np.stack([s, e], 1).ravel(), len(text)]
                    digest = hashlib.sha256()
                    for a, b in zip(edges[::2], edges[1::2]):
                        digest.update(text[a:b])
                    out.append((doc, len(text), int((e - s).sum()), len(s), digest.hexdigest(), s.tolist(), e.tolist()))
                yield pa_batch(out, _RESULT, ["int64", "int64", "int64", "int64", "string", "list", "list"])

    anchors = documents.mapInArrow(announce, "bucket int, pack long, anchors binary, several binary")
    answers = anchors.groupBy("bucket").applyInPandas(shared, "pack long, bucket int, bits binary")
    answers = answers.groupBy(F.col("pack").alias("_pack")).agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    texts = documents.mapInArrow(packed, "pack long, ids binary, offsets binary, data binary")
    met = texts.join(answers, texts.pack == answers._pack, "left").drop("_pack")
    sent = met.mapInArrow(send, ", ".join(f"{c} {t}" for c, t in zip(_SENT, ["int", "long", *["binary"] * 8])))
    gone = checkpointed(sent.groupBy("bucket").applyInPandas(settle, "pack long, gone binary"))
    del anchors, answers, met, sent
    released(documents.sparkSession)  # the first passes' shuffle files
    gone = gone.groupBy(F.col("pack").alias("_pack")).agg(F.collect_list("gone").alias("gone"))
    out = texts.join(gone, texts.pack == gone._pack, "left").select("pack", "ids", "offsets", "data", "gone")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    found = out.mapInArrow(finish, schema).withColumn("doc_id", F.col("doc_id").cast(id_type))
    text = F.coalesce("text", F.lit(""))
    empty = F.array().cast("array<long>")
    rest = documents.where("doc_id is null").select("doc_id", F.octet_length(text).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2(text, 256), empty, empty)
    return found.union(rest)


_SENT = ["bucket", "pack", "anchors", "spans", "which", "sizes", "texts", "rows", "docs", "starts"]
_RESULT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]


def pa_batch(rows: list[tuple], names: list[str], kinds: list[str]):
    import pyarrow as pa

    types = {"int32": pa.int32(), "int64": pa.int64(), "binary": pa.binary(), "string": pa.string(), "list": pa.list_(pa.int64())}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds)], names=names)
