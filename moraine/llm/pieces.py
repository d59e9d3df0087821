"""Sampled SentencePiece segmentations and lossless decoding.

The lattice of a text has a node per character and an edge per vocabulary piece that matches.
Forward filtering gives each node the log-sum of the weights of all paths to it; backward sampling
walks from the end, taking an incoming edge with its share of that sum, so every segmentation comes
up with exactly its probability.  No piece crosses the end of a word, so lattices are built per
distinct word (many at once) and all words of many texts are walked in step.  Random numbers are
hashes of (seed, row key, word number, step), and an edge's threshold is a 32-bit integer that its
own word alone sets: results depend on the row alone, whatever was read before it.

Lattices are kept in arrays of a fixed size for the words to come (``bound`` bytes a worker process);
when they are full they start anew.  Words are learned and walked in slices, so neither long texts nor
large batches need more memory; only a single word longer than the whole cache does.

Weights: a unigram model's own log-probabilities; for a merge (BPE) model, whose scores are ranks,
``-log(rank + 2)``.  ``alpha`` sharpens them.  Characters without a piece become their bytes.

Defined cases: null text is empty; empty text has no pieces; equal keys and texts get equal
segmentations; texts of any length and any characters, the space mark U+2581 included, are decoded
to exactly themselves.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from moraine.llm.common import fresh, given_back
from moraine.llm.shingles import mix

_MARK, _STOP = "▁", "\x00"
_WORDS = re.compile(r"\n| *[^ \n]+| +")


class Sampler:
    """One vocabulary with its lattice cache.  ``bound``: bytes that the cache takes at most."""

    def __init__(self, model: str, alpha: float = 1.0, bound: int = 48 << 20):
        import sentencepiece

        spm = sentencepiece.SentencePieceProcessor(model_file=model)
        n = spm.get_piece_size()
        self.bytes_of, self.byte_id, plain = [b""] * n, [0] * 256, {}
        # A word takes about 200 bytes with its dictionary entry, and has about 10 nodes of 5 bytes and 20
        # edges of 12 bytes.
        words = max(bound // 500, 64)
        self.rooms = {"words": words, "nodes": 11 * words, "edges": 21 * words}
        scores = [spm.get_score(i) for i in range(n)]
        ranked = min((s for i, s in enumerate(scores) if not (spm.is_control(i) or spm.is_unknown(i) or spm.is_byte(i))), default=0) < -1000
        for i in range(n):
            piece = spm.id_to_piece(i)
            if spm.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (spm.is_control(i) or spm.is_unknown(i) or spm.is_unused(i)):
                text = piece.replace(_MARK, " ")
                plain[text] = i
                self.bytes_of[i] = text.encode()
        if any(" " in p.lstrip(" ") or "\n" in p for p in plain):
            raise ValueError("a piece of this vocabulary crosses the end of a word")
        weight = np.array([-np.log(2.0 - s) if ranked else s for s in scores])
        lowest = float(weight[list(plain.values())].min())
        self.weight = alpha * np.where(np.isin(np.arange(n), self.byte_id), lowest, weight)
        for b in range(128):  # an unknown character of one byte is an edge like any other
            plain.setdefault(chr(b), self.byte_id[b])
        self.plain, self.known, self.longest = plain, {p for p in plain if len(p) == 1}, max(map(len, plain))
        self.automaton = ahocorasick.Automaton()
        self.single = np.full(0x110000, -1, np.int32)  # pieces of one character, by code point
        for p, i in plain.items():
            if len(p) == 1:
                self.single[ord(p)] = i
            else:
                self.automaton.add_word(p, i * 64 + len(p))
        self.automaton.make_automaton()
        self.sizes = np.array([len(b) for b in self.bytes_of])
        self.starts = np.r_[0, np.cumsum(self.sizes)][:-1]
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.clear()

    def clear(self, nodes: int = 0, edges: int = 0) -> None:
        """An empty cache, with room for a word of so many nodes and edges."""
        nodes, edges = max(nodes, self.rooms["nodes"]), max(edges, self.rooms["edges"])
        self.ends: dict[str, int] = {}
        self.nodes = self.edges = 0
        self.upto, self.came, self.piece = np.empty(edges, np.uint32), np.empty(edges, np.int32), np.empty(edges, np.int32)
        self.root, self.first = np.zeros(nodes, bool), np.empty(nodes, np.int32)

    def _add(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, roots: np.ndarray, nodes: int) -> bool:
        """Forward filtering over lattices laid out side by side; edges ordered by their end.  False
        if there is no room for them."""
        if self.nodes + nodes > len(self.root) or self.edges + len(end) > len(self.upto):
            return False
        level = end - roots[np.searchsorted(roots, end, "right") - 1]
        total = np.full(nodes, -np.inf)
        total[roots] = 0
        share = np.empty(len(end))
        by_level = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[by_level], np.arange(1, int(level.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            e = by_level[a:b]
            if not len(e):
                continue
            w = total[start[e]] + self.weight[piece[e]]
            head = np.flatnonzero(np.r_[True, end[e][1:] != end[e][:-1]])
            high = np.maximum.reduceat(w, head)
            size = np.diff(np.r_[head, len(e)])
            got = np.exp(w - np.repeat(high, size))
            mass = np.add.reduceat(got, head)
            total[end[e][head]] = high + np.log(mass)
            share[e] = got / np.repeat(mass, size)
        head = np.flatnonzero(np.r_[True, end[1:] != end[:-1]])
        size = np.diff(np.r_[head, len(end)])
        for k in range(1, int(size.max(initial=1))):  # running sums within each node's edges only
            at = head[size > k] + k
            share[at] += share[at - 1]
        upto = np.minimum(share * 2.0**32, 2.0**32 - 1).astype(np.uint32)  # the last draw of each edge
        upto[head + size - 1] = 0xFFFFFFFF
        s = slice(self.edges, self.edges + len(end))
        self.upto[s], self.came[s], self.piece[s] = upto, self.nodes + start, piece
        self.root[self.nodes : self.nodes + nodes] = False
        self.root[self.nodes + roots] = True
        self.first[self.nodes : self.nodes + nodes] = self.edges + np.searchsorted(end, np.arange(nodes))
        self.edges += len(end)
        self.nodes += nodes
        return True

    def _lattices(self, words: list[str]):
        """(start, end, piece, roots, nodes, ends) of the lattices of words whose characters are all pieces."""
        joined = _STOP.join(words) + _STOP
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size + 1) - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joined)), np.int64).reshape(-1, 2)
        lone = np.ones(len(joined), bool)
        lone[stop] = False
        lone = np.flatnonzero(lone)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)[lone]
        end = np.concatenate([lone, found[:, 0]]) + 1
        value = np.concatenate([self.single[code].astype(np.int64) * 64 + 1, found[:, 1]])
        order = np.argsort(end, kind="stable")
        end, value = end[order], value[order]
        return end - value % 64, end, (value // 64).astype(np.int64), stop - size, len(joined), stop

    def _mixed_lattice(self, word: str):
        """The same of one word with characters that become bytes: a node per byte of each."""
        edges, at = [], [0]
        for k, c in enumerate(word):
            if c in self.known:
                at.append(at[-1] + 1)
                edges += [(at[k + 1 - n], at[k + 1], self.plain[word[k + 1 - n : k + 1]]) for n in range(1, min(self.longest, k + 1) + 1) if word[k + 1 - n : k + 1] in self.plain]
            else:
                raw = c.encode()
                edges += [(at[k] + b, at[k] + b + 1, self.byte_id[x]) for b, x in enumerate(raw)]
                at.append(at[k] + len(raw))
        e = np.array(sorted(edges, key=lambda x: x[1]), np.int64)
        return e[:, 0], e[:, 1], e[:, 2], np.array([0]), at[-1] + 1, np.array([at[-1]])

    def _hold(self, words: list[str], made) -> bool:
        *lattice, nodes, ends = made
        base = self.nodes
        if not self._add(*lattice, nodes):
            return False
        self.ends.update(zip(words, (base + ends).tolist()))
        return True

    def learn(self, words: list[str]) -> bool:
        """Build the lattices of new words; false if the cache has no room for them."""
        if len(self.ends) + len(words) > self.rooms["words"] and self.ends:
            return False
        simple = [w for w in words if self.known.issuperset(w)]
        if simple and not self._hold(simple, self._lattices(simple)):
            return False
        return all(self._hold([w], self._mixed_lattice(w)) for w in words if w not in self.ends)

    def _node_of(self, words: list[str]) -> np.ndarray:
        """The last node of each word's lattice."""
        if len(self.upto) > self.rooms["edges"]:
            self.clear()  # a large word has been
        new = sorted({w for w in words if w not in self.ends})
        if new and not self.learn(new):
            self.clear()
            every = sorted(set(words))
            if not self.learn(every):  # a word or a slice beyond the bound: room for it, given back with the next
                size = sum(4 * len(w) + 1 for w in every)
                self.clear(size, size * (self.longest + 1))
                self.learn(every)
        return np.fromiter(map(self.ends.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str], seeds: np.ndarray, step: int = 32768, width: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets) sampled for rows with these 64-bit seeds; ``step`` words or
        ``width`` characters at most at a time."""
        words, counts = [], []
        for t in texts:
            own = _WORDS.findall(" " + t) if t else []  # the model puts a space before a text
            counts.append(len(own))
            words += own
        n = len(words)
        counts = np.array(counts, np.int64)
        first = np.cumsum(counts) - counts
        place = np.arange(n) - np.repeat(first, counts)
        seed = mix(np.repeat(seeds.astype(np.uint64), counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        upto = np.cumsum(np.fromiter(map(len, words), np.int64, n))
        parts, sizes, s = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while s < n:
            e = min(s + step, max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + width, "right"))))
            ids, steps = self._walk(self._node_of(words[s:e]), seed[s:e])
            parts.append(ids)
            sizes.append(steps)
            s = e
        return np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))][np.r_[first, n]]

    def _walk(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward sampling of words with these last nodes: their pieces in order, and how many each has."""
        live, steps, taken, step = np.arange(len(node)), np.zeros(len(node), np.int64), [], 0
        while len(live):
            draw = (mix(seed[live] + np.uint64(step)) >> np.uint64(32)).astype(np.uint32)
            edge = self.first[node]
            left = np.flatnonzero(self.upto[edge] < draw)
            while len(left):  # a node has two edges on average
                edge[left] += 1
                left = left[self.upto[edge[left]] < draw[left]]
            taken.append((live, self.piece[edge]))
            steps[live] += 1
            node = self.came[edge]
            more = ~self.root[node]
            live, node = live[more], node[more]
            step += 1
        stop = np.cumsum(steps)
        ids = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
        for k, (who, piece) in enumerate(taken):
            ids[stop[who] - 1 - k] = piece
        return ids, steps

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the text that the pieces stand for."""
        size = self.sizes[ids]
        total = int(size.sum())
        if not total:
            return b""
        where = np.repeat(self.starts[ids] - (np.cumsum(size) - size), size) + np.arange(total)
        return self.all_bytes[where].tobytes()[1:]  # without the space put before


@lru_cache(maxsize=2)
def sampler(model: str, alpha: float) -> Sampler:
    """One per worker process."""
    return Sampler(model, alpha)


def encode(documents: DataFrame, model: str, alpha: float = 1.0, seed: int = 1, key: str = "doc_id", text: str = "text", chunk: int = 1 << 17) -> DataFrame:
    """All columns of ``documents`` and ``pieces`` (array of int), ``lossless`` (whether decoding
    gives the text back); columns of these names are replaced.  ``model`` is a path that every
    executor can open.  One narrow pass."""
    rest = documents.drop("pieces", "lossless")
    seeded = fresh(rest, "seed")
    schema = StructType([*rest.schema.fields, StructField("pieces", ArrayType(IntegerType())), StructField("lossless", BooleanType())])

    def run(batches):
        import pyarrow as pa

        tool = sampler(model, alpha)
        for batch in batches:
            column, seeds = batch.column(text), batch.column(seeded).to_numpy(zero_copy_only=False).view(np.uint64)
            at = 0
            while at < len(batch):
                texts, size, begin = [], 0, at
                while at < len(batch) and (not texts or size < chunk):
                    texts.append(column[at].as_py() or "")
                    size += len(texts[-1])
                    at += 1
                ids, bounds = tool.encode(texts, seeds[begin:at])
                good = [tool.decode(ids[a:b]) == t.encode() for t, a, b in zip(texts, bounds[:-1], bounds[1:])]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                part = batch.slice(begin, at - begin)
                part = part.select([c for c in part.schema.names if c != seeded])
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(good)], names=[*part.schema.names, "pieces", "lossless"])
        tool.clear()  # the worker's next task may be another operator's

    return rest.withColumn(seeded, F.xxhash64(F.lit(seed), F.col(key))).mapInArrow(given_back(run), schema)
