"""Temperature mixing of sources, realised as budgeted block permutations.

Source i with token share p_i gets the weight p_i**a / sum_j p_j**a.  The
exponent a in [0, 1] is bisected until the weights have a target entropy, or
until no source repeats more often than a limit within the token budget.  The
budget of a source is its weight times the total; it is filled by epochs, each
a permutation of the source's documents, the last one cut where the budget is
reached.  A document's place in its source's stream, from 0 to 1, gives its
block, so every block holds the sources in the target weights, and the rows of
a block are permuted by a hash.

No budget given, the total is the least that gives every document once: the
largest source is read once and the smaller ones repeat, so nothing is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.llm.common import text_key
from kinweave.storage import materialize

COLLECT_SOURCES = 100_000
CELL_ROWS = 1_000


@dataclass(frozen=True)
class Target:
    """What the exponent is to meet: ``entropy`` in nats, or ``repeats`` as the most epochs of any source."""

    entropy: float | None = None
    repeats: float | None = None

    def __post_init__(self) -> None:
        if (self.entropy is None) == (self.repeats is None):
            raise ValueError("give either an entropy or a limit of repeats")


class Shares:
    """Sums over the sources' shares: on the driver for a checked number of sources, else one Spark job per question."""

    def __init__(self, sources: DataFrame):
        head = sources.where("tokens > 0").agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
        self.count, self.total, self.least, self.most = head[0], float(head[1] or 0), float(head[2] or 0), float(head[3] or 0)
        self._frame = sources.where("tokens > 0").select((F.col("tokens") / F.lit(self.total or 1.0)).alias("p"))
        self._local = np.array([r[0] for r in self._frame.collect()]) if self.count <= COLLECT_SOURCES else None

    def norm_and_entropy(self, a: float) -> tuple[float, float]:
        """(sum of p**a, entropy of the weights)."""
        if self._local is not None:
            q = self._local**a
            z = q.sum()
            return float(z), float(-(q / z * np.log(q / z)).sum())
        powered = F.pow("p", F.lit(a))
        z, s = self._frame.agg(F.sum(powered), F.sum(powered * F.log("p"))).first()
        return z, math.log(z) - a * s / z

    def budget(self, a: float, total: float | None) -> float:
        """The token total: given, or the least at which every source's budget covers it."""
        if total is not None:
            return total
        z, _ = self.norm_and_entropy(a)
        return self.most * z / (self.most / self.total) ** a  # the largest source repeats least

    def most_repeats(self, a: float, total: float | None) -> float:
        z, _ = self.norm_and_entropy(a)
        return max(self.budget(a, total) * (t / self.total) ** a / z / t for t in (self.least, self.most))


def bisect(f: Callable[[float], float], goal: float, steps: int = 60) -> float:
    """The a in [0, 1] at which the decreasing f reaches the goal; the nearer end if it doesn't."""
    lo, hi = 0.0, 1.0
    if f(lo) <= goal:
        return lo
    if f(hi) >= goal:
        return hi
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) > goal else (lo, mid)
    return hi


def solve_exponent(shares: Shares, target: Target, total: float | None = None) -> float:
    """The exponent that meets the target.

    An entropy beyond that of equal weights gives 0, one below that of the
    shares themselves gives 1.  A limit of repeats that even the natural
    shares exceed (a large total) gives 1.
    """
    if shares.count == 0:
        return 1.0
    if target.entropy is not None:
        return bisect(lambda a: shares.norm_and_entropy(a)[1], target.entropy)
    return bisect(lambda a: shares.most_repeats(a, total), target.repeats)


def word_count(text: Column) -> Column:
    """White-space separated words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def plan_mix(units: DataFrame, target: Target, total: float | None = None, block_tokens: int = 1 << 20, seed: int = 0) -> tuple[DataFrame, float]:
    """(unit columns..., epoch, block, position) for every emission of a unit, and the exponent.

    ``units``: (u1, u2, source, tokens, copies, ...), one row per unit; an
    emission of several copies takes as many positions from ``position`` on.
    Units without tokens cost nothing and are emitted in the first epoch alone,
    spread over the blocks by their hash and counted as a token each in the
    number of blocks, so that no block gathers them.  Each source
    and epoch is dealt into hash cells whose sums are added up first, so that a
    source with most of the rows is no single task's: n rows of a source make
    n / max(CELL_ROWS, sqrt(n)) cells, so neither the cells nor the rows of one
    exceed the square root by much.
    """
    sources = units.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("tokens") == 0, F.col("copies")).otherwise(0)).alias("blank"))
    sources = materialize(sources, "mix-sources")
    shares = Shares(sources)
    a = solve_exponent(shares, target, total)
    z, _ = shares.norm_and_entropy(a) if shares.count else (1.0, 0.0)
    budget = shares.budget(a, total) if shares.count else 0.0
    blank = sources.agg(F.sum("blank")).first()[0] or 0
    blocks = max(1, math.ceil((budget + blank) / block_tokens))
    weight = F.pow(F.col("tokens") / F.lit(shares.total or 1.0), F.lit(a)) / F.lit(z)
    # rounded so that a budget equal to the source's size is not a hair under it
    plans = sources.select("source", F.col("tokens").alias("source_tokens"), F.ceil(F.lit(budget) * weight - F.lit(1e-6)).cast("long").alias("source_budget"), F.ceil(F.col("rows") / F.greatest(F.lit(float(CELL_ROWS)), F.sqrt("rows"))).alias("cells"))
    plans = plans.withColumn("epochs", F.when(F.col("source_tokens") > 0, F.ceil(F.col("source_budget") / F.col("source_tokens"))).otherwise(1).cast("int"))
    joined = units.join(plans, units["source"].eqNullSafe(plans["source"])).drop(plans["source"])
    each = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("epochs") - 1))))
    each = each.withColumn("order", F.xxhash64("u1", "u2", "epoch", F.lit(seed)))
    # cells are consecutive ranges of the order hash, so the permutation runs through them
    each = each.withColumn("cell", F.expr("cast(floor((order / 18446744073709551616D + 0.5D) * cells) as int)"))
    key = ["source", "epoch", "cell"]
    own = F.sum("tokens").over(Window.partitionBy(*key).orderBy("order", "u1", "u2").rowsBetween(Window.unboundedPreceding, -1))
    sums = each.groupBy(*key).agg(F.sum("tokens").alias("cell_tokens"))
    base = F.sum("cell_tokens").over(Window.partitionBy("source").orderBy("epoch", "cell").rowsBetween(Window.unboundedPreceding, -1))
    bases = sums.select(*key, F.coalesce(base, F.lit(0)).alias("cell_base"))
    each = each.withColumn("own_base", F.coalesce(own, F.lit(0)))
    placed = each.join(bases, each["source"].eqNullSafe(bases["source"]) & (each["epoch"] == bases["epoch"]) & (each["cell"] == bases["cell"])).drop(bases["source"]).drop(bases["epoch"]).drop(bases["cell"])
    start = F.col("cell_base") + F.col("own_base")
    emitted = placed.withColumn("start", start).where("(source_tokens > 0 and tokens > 0 and start < source_budget) or (tokens = 0 and epoch = 0)")
    spread = F.expr("order / 18446744073709551616D + 0.5D")
    share = F.when(F.col("tokens") == 0, spread).otherwise(F.least(F.col("start") / F.greatest(F.col("source_budget"), F.lit(1)), F.lit(1.0)))
    emitted = emitted.withColumn("block", F.least(F.floor(share * blocks), F.lit(blocks - 1)).cast("int"))
    ahead = Window.partitionBy("block").orderBy(F.xxhash64("order", "block"), "u1", "u2", "epoch").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("copies").over(ahead), F.lit(0))
    kept = [c for c in units.columns]
    return emitted.select(*kept, "epoch", "block", within.alias("position")), a


def mix_sources(docs: DataFrame, target: Target, total: float | None = None, block_tokens: int = 1 << 20, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, tokens, epoch, block, position): the mixed sequence, to be read by block and position.

    Rows equal in key, source and text are one unit: they stand side by side
    wherever it is emitted.  No place is given twice.  A null source is a source of its own; null
    and blank texts have no tokens and are emitted once; null keys are keys.
    An empty table gives an empty table.  Other columns are not returned.
    """
    units, folded = _units(docs, key, text, source)
    planned, _ = plan_mix(units, target, total, block_tokens, seed)
    out = planned
    if folded:
        out = out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1))).withColumn("position", F.col("position") + F.col("copy"))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), (F.col("tokens") / F.col("copies")).cast("long").alias("tokens"), "epoch", "block", "position")


def _units(docs: DataFrame, key: str, text: str, source: str) -> tuple[DataFrame, bool]:
    k1, k2 = text_key(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.xxhash64(F.col(f"`{key}`"), k1).alias("u1"), F.xxhash64(F.lit("unit"), F.col(f"`{key}`"), F.col(f"`{source}`"), k2).alias("u2"), word_count(F.col(f"`{text}`")).alias("n"))
    units = rows.groupBy("key", "source", "u1", "u2").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("copies"))
    units = materialize(units, "mix-units")
    return units, not units.where("copies > 1").isEmpty()


def mixed_documents(docs: DataFrame, target: Target, total: float | None = None, block_tokens: int = 1 << 20, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix emits them, all columns unchanged.

    Null sources, keys and texts and blank texts are treated as in
    ``mix_sources``; each of several equal rows comes as often as their unit is
    emitted; an empty table stays empty; column names may be any.
    """
    units, _ = _units(docs, key, text, source)
    planned, _ = plan_mix(units, target, total, block_tokens, seed)
    taken = {c.lower() for c in docs.columns}
    u1, u2, times = (next(n for i in range(len(taken) + 1) if (n := f"__kw_{base}{i}") not in taken) for base in ("first", "second", "times"))
    counted = planned.groupBy(F.col("u1").alias(u1), F.col("u2").alias(u2)).agg(F.count(F.lit(1)).alias(times))
    k1, k2 = text_key(F.col(f"`{text}`"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(*columns, F.xxhash64(F.col(f"`{key}`"), k1).alias(u1), F.xxhash64(F.lit("unit"), F.col(f"`{key}`"), F.col(f"`{source}`"), k2).alias(u2))
    repeated = marked.join(counted, [u1, u2])
    return repeated.withColumn(times, F.expr(f"explode(sequence(1, cast({times} as int)))")).select(*columns)
