"""Word shingles of many texts at once, as sets of 64-bit hashes.

Texts are UTF-8 bytes; A-Z is lower-cased and words are runs of bytes other than space and
0x09-0x0D.  A text's set holds its distinct shingles of ``words`` words; a text with fewer words has
the whole sequence as its only shingle, a text without words the empty set.  All is numpy over the
Arrow buffers of a batch, in chunks of whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes and texts of a chunk: they set how much a worker holds at once, 2048 counters of a sketch for each text among it.
CHUNK, TEXTS = 1 << 18, 1 << 9
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_SPACE] = 0
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """(first, after last) rows of chunks of about ``size`` bytes and at most ``TEXTS`` rows."""
    first = 0
    while first < len(offsets) - 1:
        last = min(max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1), first + TEXTS)
        yield first, last
        first = last


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct shingle, ordered by row and hash, for the rows of ``offsets``."""
    low, rows = int(offsets[0]), len(offsets) - 1
    a = data[low : int(offsets[-1])]
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if not len(a):
        return none
    at = offsets - low
    inside = ~_SPACE[a]
    start = inside.copy()
    start[1:] &= _SPACE[a[:-1]]
    heads = at[:-1][at[:-1] < at[1:]]
    start[heads] = inside[heads]
    begins = np.flatnonzero(start)
    if not len(begins):
        return none
    index = np.arange(len(a))
    place = index - np.maximum.accumulate(np.where(start, index, 0))
    value = _BYTE[a] * powers(_BASE, int(place.max()) + 1)[place]
    if begins[0]:
        value[: begins[0]] = 0
    word = mix(np.add.reduceat(value, begins))
    row = np.searchsorted(at, begins, "right") - 1
    n = np.bincount(row, minlength=rows)
    step = powers(_STEP, words + 1)
    if len(word) >= words:
        whole = sum((word[k : len(word) - words + 1 + k] * step[k] for k in range(words)), np.zeros(1, np.uint64))
        same = row[: len(word) - words + 1] == row[words - 1 :]
        row_of, shingle = row[: len(word) - words + 1][same], whole[same]
    else:
        row_of, shingle = none
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        first = np.searchsorted(row, short)
        lone = np.array([int(sum(int(word[f + k]) * int(step[k]) for k in range(n[r]))) * 31 + int(n[r]) & (1 << 64) - 1 for f, r in zip(first, short)], np.uint64)
        row_of, shingle = np.concatenate([row_of, short]), np.concatenate([shingle, lone])
    shingle = mix(shingle)
    order = np.lexsort((shingle, row_of))
    row_of, shingle = row_of[order], shingle[order]
    new = np.ones(len(row_of), bool)
    new[1:] = (row_of[1:] != row_of[:-1]) | (shingle[1:] != shingle[:-1])
    return row_of[new], shingle[new]
