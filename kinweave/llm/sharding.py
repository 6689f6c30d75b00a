"""Reproducible sharding: a Feistel permutation of global row numbers with cycle walking.

Row numbers 0..n-1 are permuted by an unbalanced Feistel network over the
rectangle a x b >= n (Black and Rogaway, "Ciphers with Arbitrary Finite
Domains", 2002).  A value that leaves the domain is permuted again until it is
inside (cycle walking); at most a*b - n values lie outside, which bounds the
walk, so the permutation is exact for every n.  The permuted number p gives
shard p mod k and slot p div k: any row's place can be computed without a
shuffle, shard sizes differ by at most one row, and slots have no gaps.
Everything is an SQL expression.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, functions as F

from kinweave.llm.common import global_row_numbers

PRIME = (1 << 31) - 1
RECTANGLES = 4096


class Feistel:
    """A keyed permutation of 0..n-1 as Spark SQL and as plain Python."""

    def __init__(self, n: int, seed: int = 0, rounds: int = 6):
        if n < 0:
            raise ValueError("n must not be negative")
        if n > 1 << 60:
            raise ValueError("n is limited to 2**60 rows")
        self.n = n
        # of many nearly square rectangles the one with the fewest values outside, so that walks are short
        root = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.a = min(range(root, root + min(root, RECTANGLES)), key=lambda a: a * max(1, -(-n // a)))
        self.b = max(1, -(-n // self.a))
        rng = random.Random(f"{seed}/{rounds}")
        self.keys = [tuple(rng.randrange(1, PRIME) for _ in range(3)) for _ in range(rounds)]
        self.outside = self.a * self.b - n

    def _mix(self, v: int, key: tuple[int, int, int]) -> int:
        p, q, r = key
        return (v % PRIME * (v % PRIME) % PRIME * p + v % PRIME * q % PRIME + r) % PRIME

    def step(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i, key in enumerate(self.keys):
            if i % 2:
                right = (right + self._mix(left, key)) % self.b
            else:
                left = (left + self._mix(right, key)) % self.a
        return left * self.b + right

    def __call__(self, x: int) -> int:
        x = self.step(x)
        while x >= self.n:
            x = self.step(x)
        return x

    def step_sql(self, x: str) -> str:
        """One permutation of the rectangle as a Spark SQL expression."""
        mix = lambda v: f"(((({v} % {PRIME}) * ({v} % {PRIME})) % {PRIME}) * k.p + (({v} % {PRIME}) * k.q) % {PRIME} + k.r) % {PRIME}"
        keys = ", ".join(
            f"named_struct('odd', {str(i % 2 == 1).lower()}, 'p', {p}L, 'q', {q}L, 'r', {r}L)" for i, (p, q, r) in enumerate(self.keys)
        )
        return (
            f"aggregate(array({keys}), named_struct('l', cast({x} div {self.b} as bigint), 'r', cast({x} % {self.b} as bigint)), "
            f"(s, k) -> if(k.odd, named_struct('l', s.l, 'r', (s.r + {mix('s.l')}) % {self.b}), "
            f"named_struct('l', (s.l + {mix('s.r')}) % {self.a}, 'r', s.r)), "
            f"s -> s.l * {self.b} + s.r)"
        )

    def sql(self, x: str) -> str:
        """The whole permutation; only values outside the domain enter the walk."""
        if self.n == 0:
            return "cast(null as bigint)"
        once = f"transform(array({x}), y -> {self.step_sql('y')})[0]"
        walk = f"aggregate(sequence(1, {max(1, self.outside)}), z, (w, i) -> if(w < {self.n}, w, {self.step_sql('w')}))"
        return f"transform(array({once}), z -> if(z < {self.n}, z, {walk}))[0]"


def shard_rows(df: DataFrame, keys: list[str], n_shards: int, seed: int = 0, rows: str = "row_no") -> DataFrame:
    """Add the global row number, ``shard`` (int, 0..n_shards-1) and ``slot`` (long, gapless from 0).

    Rows are numbered by ``keys`` (nulls first, ties by all columns), so the
    result does not depend on partitioning.  Equal rows get different places.
    Input columns named like the added ones are replaced.  Null keys and texts
    are ordinary values; an empty table gives an empty table; fewer rows than
    shards leave the last shards empty.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    numbered = global_row_numbers(df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot", "__kw_place")]), keys, rows)
    feistel = Feistel(numbered.count(), seed)
    return (
        numbered.withColumn("__kw_place", F.expr(feistel.sql(f"`{rows}`")))
        .withColumn("shard", (F.col("__kw_place") % n_shards).cast("int"))
        .withColumn("slot", F.expr(f"__kw_place div {n_shards}"))
        .drop("__kw_place")
    )
