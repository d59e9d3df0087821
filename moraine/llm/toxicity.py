"""Toxicity scores from a weighted lexicon.

Text is folded (case, look-alike letters, digit substitutions), matched against the lexicon by an
Aho-Corasick automaton, and the weights of the hits that no exception phrase covers are normalised
by length.  Lexicon, weights, exception phrases and the calibration of the score are learned from
labelled rows; the sample that they are learned from is bounded by ``max_train`` rows a class.

Defined cases: null and empty texts score as a text without hits; null labels are left out of the
training rows; an empty training set gives score 0 for all.  Whole texts are scored, however long.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import given_back

# Letters of other scripts that look like Latin ones, and digits written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}

_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | {chr(0xFF41 + i): chr(97 + i) for i in range(26)})
_INNER = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
#: Characters of a prefix.  Whole words count at any length.
_SHORTEST, _LONGEST = 3, 12


def fold(text: str) -> str:
    """Lower case, look-alikes and digit substitutions undone; keeps the number of characters
    unless lower-casing changes it."""
    text = text.lower().translate(_FOLD)
    if "@" in text or "$" in text:
        text = _INNER.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text


def _features(words: set[str]) -> set[str]:
    """Prefixes of the words, and the whole words with an end mark."""
    out = set()
    for w in words:
        for n in range(_SHORTEST, min(len(w), _LONGEST) + 1):
            out.add(w[:n])
        if len(w) >= _SHORTEST:
            out.add(w + "$")
    return out


@dataclass
class Lexicon:
    """entries: pattern (a word prefix, or a whole word ending in ``$``) to weight; exceptions:
    phrases of two folded words within which a hit does not count; coef: bias and coefficients."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    coef: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def automaton(self):
        if not self.entries:
            return None
        out = ahocorasick.Automaton()
        for pattern, weight in self.entries.items():
            word = pattern.rstrip("$")
            known = out.get(word, [])
            out.add_word(word, [*known, (len(word), pattern.endswith("$"), weight, pattern)])
        out.make_automaton()
        return out

    def hits(self, text: str, automaton) -> list[tuple[int, int, str, float]]:
        """(start, end, pattern, weight) of each word hit in the folded text; the heaviest pattern
        counts where several start at one word."""
        if automaton is None or not text:
            return []
        best: dict[int, tuple[int, int, str, float]] = {}
        for end, found in automaton.iter(text):
            for size, whole, weight, pattern in found:
                start = end - size + 1
                if start and text[start - 1].isalnum():
                    continue
                if whole and end + 1 < len(text) and text[end + 1].isalnum():
                    continue
                if start not in best or weight > best[start][3]:
                    best[start] = (start, end + 1, pattern, weight)
        if not self.exceptions:
            return list(best.values())
        return [h for h in best.values() if not any(p in self.exceptions for p in phrases(text, h[0]))]

    def score(self, weight: float, length: int) -> float:
        z = float(np.dot(self.coef, _inputs(weight, length)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _inputs(weight: float, length: int) -> tuple[float, float, float]:
    """Bias, total weight, and weight by length (per 1000 characters), both damped."""
    return 1.0, math.log1p(weight), math.log1p(1000 * weight / max(length, 20))


def phrases(text: str, start: int) -> list[str]:
    """The two-word phrases around the word that starts there."""
    own = _WORD.match(text, start)
    if not own:
        return []
    to = start
    while to and not text[to - 1].isalnum():
        to -= 1
    at = to
    while at and text[at - 1].isalnum():
        at -= 1
    after = _WORD.search(text, own.end())
    out = [f"{text[at:to]} {own[0]}"] if at < to else []
    return out + ([f"{own[0]} {after[0]}"] if after else [])


def fit(train: DataFrame, max_train: int = 3000, min_families: int = 6, min_share: float = 0.008, min_weight: float = 3.0, seed: int = 17) -> Lexicon:
    """Learn a lexicon from ``train`` (``text``, ``label`` 0 or 1; other columns are ignored).

    At most ``max_train`` rows a class are taken, by a hash of their text.  A pattern is taken if it
    is in texts of ``min_families`` families (texts of one family share the word of smallest hash,
    so copies of a text count once or a few times) and its log-odds reach ``min_weight``.  The
    statistics sent to the driver are bounded by the sample.
    """
    rows = train.select(F.col("text"), F.col("label").cast("int").alias("label")).where("text is not null and label in (0, 1)")
    rows = rows.withColumn("_order", F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_000)))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return Lexicon()
    spark = train.sparkSession
    keep = []
    for label in (0, 1):
        share = min(1.0, 1.05 * max_train / counts[label])
        keep.append(rows.where((F.col("label") == label) & (F.col("_order") < int(share * 1_000_000))))
    sample = keep[0].unionByName(keep[1]).persist()
    try:
        def families(positive: int, wanted: frozenset | None):
            def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                seen: set[tuple[str, int]] = set()
                for part in parts:
                    for text in part["text"]:
                        words = set(_WORD.findall(fold(text)))
                        if words:
                            family = min(hash_word(w) for w in words)
                            got = _features(words)
                            seen.update((f, family) for f in (got if wanted is None else got & wanted))
                if seen:
                    yield pd.DataFrame(list(seen), columns=["feature", "family"])

            return sample.where(F.col("label") == positive).mapInPandas(given_back(count), "feature string, family long").groupBy("feature").agg(F.countDistinct("family").alias("n"))

        totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.countDistinct("text").alias("n")).collect()}
        least = max(min_families, int(min_share * totals.get(1, 0)))
        toxic = {r["feature"]: r["n"] for r in families(1, None).where(F.col("n") >= least).collect()}
        clean = {r["feature"]: r["n"] for r in families(0, frozenset(toxic)).collect()}
        weight = {f: math.log((n + 0.5) / (totals.get(1, 0) + 1)) - math.log((clean.get(f, 0) + 0.5) / (totals.get(0, 0) + 1)) for f, n in toxic.items()}
        lexicon = Lexicon(_chosen(toxic, clean, weight, min_weight))

        known, fold_of = spark.sparkContext.broadcast(lexicon), fold

        def contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lexicon = known.value
            automaton = lexicon.automaton()
            for part in parts:
                out = []
                for text, label in zip(part["text"], part["label"]):
                    folded = fold_of(text)
                    hits = lexicon.hits(folded, automaton)
                    out.append((int(label), float(sum(h[3] for h in hits)), len(text), sorted({p for h in hits for p in phrases(folded, h[0])})))
                yield pd.DataFrame(out, columns=["label", "weight", "size", "phrases"])

        read = sample.mapInPandas(given_back(contexts), "label int, weight double, size int, phrases array<string>").persist()
        try:
            seen = read.select("label", "weight", "size").collect()
            counts_of = read.select("label", F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count_if(F.col("label") == 0).alias("clean"), F.count_if(F.col("label") == 1).alias("toxic"))
            lexicon.exceptions = {r["phrase"] for r in counts_of.where("clean >= 3 and clean > 9 * toxic").select("phrase").collect()}
        finally:
            read.unpersist()
    finally:
        sample.unpersist()
    if seen:
        x = np.array([_inputs(r["weight"], r["size"]) for r in seen])
        y = np.array([r["label"] for r in seen], float)
        lexicon.coef = _logistic(x, y, prior=(counts[0], counts[1]))
    return lexicon


def hash_word(word: str) -> int:
    """A stable 62-bit hash (Python's own differs between processes)."""
    import xxhash

    return xxhash.xxh64_intdigest(word, 7) >> 2


def _chosen(toxic: dict, clean: dict, weight: dict, min_weight: float) -> dict[str, float]:
    """Of the patterns along a word, the longest that is about as frequent; none that a chosen
    shorter prefix covers."""
    longer: dict[str, int] = {}
    for f, n in toxic.items():
        for stem in {f[:-1]}:
            longer[stem] = max(longer.get(stem, 0), n)
    good = {f for f in toxic if weight[f] >= min_weight and longer.get(f, 0) < 0.9 * toxic[f]}
    out = {}
    for f in sorted(good, key=len):
        if not any(f[:n] in out and weight[f[:n]] >= weight[f] - 1 for n in range(_SHORTEST, len(f))):
            out[f] = weight[f]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, prior: tuple[int, int], rounds: int = 60, ridge: float = 0.05) -> tuple[float, float, float]:
    """Ridge-penalised logistic regression by Newton's method, weighted to the classes' shares."""
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    w = np.where(y == 1, prior[1] / n1, prior[0] / n0)
    w *= len(y) / w.sum()
    b = np.zeros(x.shape[1])
    penalty = ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)]) + 1e-6 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (w * (y - p)) - penalty @ b
        step = np.linalg.solve((x * (w * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + penalty, grad)
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in b)


def score(documents: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``documents`` and ``<name>`` (double, 0 to 1), ``<name>_hits`` (int).  One
    narrow pass; columns of these names are replaced."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    known = documents.sparkSession.sparkContext.broadcast(lexicon)
    rest = documents.drop(name, f"{name}_hits")
    schema = StructType([*rest.schema.fields, StructField(name, DoubleType()), StructField(f"{name}_hits", IntegerType())])

    def run(parts):
        import pyarrow as pa

        lexicon = known.value
        automaton = lexicon.automaton()
        for part in parts:
            scores, hits, column = [], [], part.column(text)
            for s in range(0, len(part), 256):  # texts as Python strings take several times their bytes
                for t in column.slice(s, 256).to_pylist():
                    found = lexicon.hits(fold(t), automaton) if t else []
                    scores.append(lexicon.score(sum(h[3] for h in found), len(t or "")))
                    hits.append(len(found))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array(hits, pa.int32())], names=[*part.schema.names, name, f"{name}_hits"])

    return rest.mapInArrow(given_back(run), schema)


def labelled(documents: DataFrame, labels: DataFrame, label: str = "toxic", on: str = "doc_id", bound: int = 40_000) -> DataFrame:
    """``text``, ``label`` of labelled documents.  At most about ``bound`` label rows take part (by a
    hash of their id), so that the side that is broadcast has a known size."""
    some = labels.select(F.col(on).alias("_id"), F.col(label).alias("label")).where("_id is not null and label is not null").distinct()
    n = some.count()
    if n > bound:
        some = some.where(F.pmod(F.xxhash64(F.lit(3), "_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    some = F.broadcast(some)
    return documents.select(F.col(on).alias("_id"), F.col("text")).join(some, "_id").select("text", "label")
