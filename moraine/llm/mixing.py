"""Mixing sources to target weights by iterative proportional fitting.

Token totals of the cells (one per combination of source, language and topic) are raked until the
marginal of each dimension meets its target.  The fitted weight of a cell over its tokens is a product
of one factor for each dimension's value, so documents need only the factors, not the cells.  A
document's sampling probability is that product times a factor that is calibrated so that the expected
tokens kept meet the budget, or the largest budget below at which no probability exceeds 1: the
expected shares are the targets.  Whether a document is kept is a hash of its id, so a rerun keeps the
same documents.

Rounds end when all marginals are within ``TOLERANCE`` of their targets.  Up to ``DRIVER_CELLS`` cells (a
few megabytes) are raked in the driver's memory; more stay in a distributed table, and a round is an
aggregation and a join of it for each dimension: the same steps under the same rule.

Defined cases: nulls in a dimension are a value of their own; null or empty texts count one token;
rows of equal id and cell are kept or dropped together; an empty table gives an empty result; columns
named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moraine.llm.common import checkpointed

#: Cells that the driver may hold.
DRIVER_CELLS = 100_000
#: A dimension's factors are sent to every executor up to so many values; more are joined by shuffles.
SENT_VALUES = 100_000


def topic(text: Column) -> Column:
    """A coarse kind of text, from marks anywhere in it."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.contains(" | "), "table").when(text.contains("!! "), "shouting")
        .when(text.contains("###") | text.contains("%%%"), "symbols").when(text.contains("@") | text.contains("://"), "contact").otherwise("prose")
    )


ROUNDS, TOLERANCE = 200, 1e-7


def raked_here(cells: DataFrame, names: list[str], powers: list[float]) -> DataFrame:
    """What :func:`raked` gives, from checkpointed cells that the driver holds.  The factors return as
    an Arrow table: one made of Python rows would start Python workers in every executor, which stay."""
    import pyarrow as pa

    cells = cells.withColumn("cell", F.monotonically_increasing_id())
    rows = cells.collect()
    tokens = np.array([r["cell_tokens"] for r in rows], float)
    whole, index, goals = tokens.sum(), [], []
    for name, power in zip(names, powers):
        place = {v: k for k, v in enumerate(dict.fromkeys(r[name] for r in rows))}
        index.append(np.array([place[r[name]] for r in rows], np.int64))
        raised = np.bincount(index[-1], tokens) ** power
        goals.append(raised / raised.sum() * whole)
    factors = [np.ones(len(g)) for g in goals]
    for _ in range(ROUNDS):
        off = 0.0
        for d, (at, goal) in enumerate(zip(index, goals)):
            weight = tokens * np.prod([f[i] for f, i in zip(factors, index)], axis=0)
            now = np.bincount(at, weight, len(goal))
            off = max(off, float(np.abs(goal - now).max()) / whole)
            factors[d] *= goal / now
        if off <= TOLERANCE:
            break
    found = pa.table({"cell": pa.array([r["cell"] for r in rows], pa.int64())} | {f"factor_{n}": f[at] for n, (f, at) in enumerate(zip(factors, index))})
    return cells.join(F.broadcast(cells.sparkSession.createDataFrame(found)), "cell").drop("cell")


def raked(cells: DataFrame, names: list[str], powers: list[float]) -> DataFrame:
    """``cells`` (``names``, ``cell_tokens``) with the fitted factor of each dimension's value,
    ``factor_<n>`` for the n-th.  Target shares are the actual ones raised to the dimension's power
    (below 1: small values gain).  Marginals are off by ``TOLERANCE`` of all tokens at most."""
    whole = cells.agg(F.sum("cell_tokens")).first()[0]
    factors = [f"factor_{n}" for n in range(len(names))]
    fitted = cells.withColumns({f: F.lit(1.0) for f in factors})
    if not whole:
        return fitted
    goals = [f"goal_{n}" for n in range(len(names))]
    for name, power, goal in zip(names, powers, goals):
        raised = checkpointed(cells.groupBy(F.col(name).alias("value")).agg(F.pow(F.sum("cell_tokens").cast("double"), F.lit(power)).alias("raised")))
        scale = whole / raised.agg(F.sum("raised")).first()[0]
        fitted = fitted.join(raised.hint("merge"), F.col(name).eqNullSafe(F.col("value"))).withColumn(goal, F.col("raised") * scale).drop("value", "raised")
    weight = F.col("cell_tokens").cast("double")
    for f in factors:
        weight = weight * F.col(f)
    for _ in range(ROUNDS):
        fitted = fitted.withColumn("off", F.lit(0.0))
        for name, f, goal in zip(names, factors, goals):
            # Merged, not broadcast: the rounds' many broadcasts would stay in the driver's memory.
            now = checkpointed(fitted.groupBy(F.col(name).alias("value")).agg(F.sum(weight).alias("now"))).hint("merge")
            fitted = fitted.join(now, F.col(name).eqNullSafe(F.col("value"))).withColumn(f, F.col(f) * F.col(goal) / F.col("now"))
            fitted = fitted.withColumn("off", F.greatest("off", F.abs(F.col(goal) - F.col("now")) / whole)).drop("value", "now")
        fitted = checkpointed(fitted)
        if fitted.agg(F.max("off")).first()[0] <= TOLERANCE:
            break
    return fitted.drop("off", *goals)


def mix(documents: DataFrame, dimensions: dict[str, Column], tokens: Column, powers: dict[str, float], keep: float = 0.8, seed: int = 11, key: str = "doc_id") -> DataFrame:
    """``documents`` with ``mix_tokens``, ``mix_probability``, ``mix_kept`` and the cell's values,
    ``mix_<dimension>``.

    ``dimensions`` names the cell's expressions, ``powers`` the tempering of each one's target
    shares; ``keep`` is the part of all tokens to keep, at most (less where the targets need it: a
    cell that they weight r times as much as it has allows 1 / r).
    """
    own = ["mix_tokens", "mix_probability", "mix_kept", *(f"mix_{d}" for d in dimensions)]
    documents = documents.drop(*own)
    columns, names = documents.columns, [f"cell_{n}" for n in range(len(dimensions))]
    flagged = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.when(F.col(key).isNull(), F.xxhash64(*flagged))), F.lit(1 << 52)) / F.lit(float(1 << 52))
    tagged = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), draw.alias("draw"), F.greatest(F.coalesce(tokens, F.lit(1)).cast("long"), F.lit(1)).alias("mix_tokens"),
        *[e.alias(n) for n, e in zip(names, dimensions.values())],
    )
    cells = checkpointed(tagged.groupBy(*names).agg(F.sum("mix_tokens").alias("cell_tokens")))
    n = cells.count()
    fitted = (raked_here if 0 < n <= DRIVER_CELLS else raked)(cells, names, [powers.get(d, 1.0) for d in dimensions])
    rate = F.lit(1.0)
    for n in range(len(names)):
        rate = rate * F.col(f"factor_{n}")
    most = fitted.agg(F.max(rate)).first()[0] or 1.0
    out = tagged
    for n, name in enumerate(names):
        factor = fitted.groupBy(F.col(name).alias(f"value_{n}")).agg(F.first(f"factor_{n}").alias(f"factor_{n}"))
        factor = F.broadcast(factor) if factor.count() <= SENT_VALUES else factor
        out = out.join(factor, F.col(name).eqNullSafe(F.col(f"value_{n}")), "left")
    # The fitted weights have the sum of the tokens, so a factor is the part that is kept.
    rate = F.least(F.lit(1.0), rate * min(keep, 1 / most))
    found = out.select("row", "mix_tokens", rate.alias("mix_probability"), (F.col("draw") < rate).alias("mix_kept"), *[F.col(n).alias(f"mix_{d}") for n, d in zip(names, dimensions)])
    return found.select("row.*", *own)


def corpus_mix(documents: DataFrame, keep: float = 0.8) -> DataFrame:
    """The production mix of ``documents``: square-root tempered sources, languages and topics, with a
    token taken as four bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("text"))}
    return mix(documents, dimensions, F.ceil(F.octet_length(text) / 4), {"source": 0.5, "lang": 0.7, "topic": 0.7}, keep)
