"""Helpers the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from kinweave.sources.tables import read_table  # noqa: F401  (re-exported for the query modules)
from kinweave.storage import materialize, shuffle_partitions


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names clash (in any case) with the columns an operator adds."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text as a grouping key."""
    return [F.xxhash64(text), F.xxhash64(F.lit("kw"), text)]


HOT_SHARE, HOT_LEAST, SALTS = 10_000, 500, 64


def join_hot(rows: DataFrame, unique: DataFrame, on: list[str], members: str, total: int, how: str = "inner", counted: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Equi-join (inner or left) of ``rows`` with a table that is unique in ``on`` and not null there; the column ``members`` is dropped.

    ``members`` says how many of the ``total`` rows each key has.  Keys with
    more than a HOT_SHARE-th of all rows are HOT_SHARE at most; they are
    broadcast to mark their rows, which are then dealt by a salt, and the keys
    are copied once for each salt.  The salt is a hash of the row, so that a
    task that is run again deals its rows alike.

    ``most``: a bound on ``members``, where known.  If it makes no key hot, the
    tables meet by a sorted join and the driver broadcasts nothing.
    """
    if most is not None and most <= max(HOT_LEAST, total // HOT_SHARE):
        return rows.join(unique.drop(members).hint("merge"), on, how)
    hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(F.lit("salt"), *hashed), F.lit(SALTS)).cast("int")
    hot = F.col(members) > max(HOT_LEAST, total // HOT_SHARE)
    marks = (unique if counted is None else counted).where(hot).select(*on, F.lit(True).alias("__kw_hot"))
    if counted is not None:
        unique, hot = unique.join(F.broadcast(marks), on, "left"), F.coalesce("__kw_hot", F.lit(False))
    dealt = rows.join(F.broadcast(marks), on, "left").withColumn("__kw_salt", F.when(F.col("__kw_hot"), salt).otherwise(0)).drop("__kw_hot")
    copies = unique.withColumn("__kw_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(members, "__kw_hot")
    return dealt.join(copies, [*on, "__kw_salt"], how).drop("__kw_salt")


def slices_by_bytes(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes of text, at least one row each: what is derived from a batch at once stays bounded."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield at, to
        at = to


def release_memory() -> None:
    """Give a Python worker's freed memory back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def global_row_numbers(df: DataFrame, keys: list[str], out: str = "row_no") -> DataFrame:
    """Add gapless numbers from 0 in the order of ``keys`` (nulls first), ties by all columns.

    Rows equal in every column are folded into one row with a count before any
    shuffle by key and unfolded after the sort, and the range partitioning uses
    a hash of the whole row behind the keys, so a repeated key or row does not
    gather in one partition.  The sorted rows are written once: the partition
    borders come from a sample, and a second evaluation could choose others.
    A column called ``out`` in the input is replaced.  Empty tables stay empty.
    """
    df = without(df, out, "__kw_n", "__kw_h", "__kw_id", "__kw_part", "__kw_base")
    cols = df.columns
    quoted = [F.col(f"`{c}`") for c in cols]
    folded = df.groupBy(*quoted).agg(F.count(F.lit(1)).alias("__kw_n")).withColumn("__kw_h", F.xxhash64(*quoted))
    order = [F.col(f"`{k}`") for k in keys] + [F.col("__kw_h"), *quoted]
    spread = folded.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialize(
        spread.select(*quoted, F.explode(F.sequence(F.lit(1), F.col("__kw_n").cast("int"))).alias("__kw_n")).select(
            *quoted, F.monotonically_increasing_id().alias("__kw_id")
        ),
        "rows",
    ).withColumn("__kw_part", F.shiftright("__kw_id", 33))
    sizes = placed.groupBy("__kw_part").agg(F.count(F.lit(1)).alias("__kw_n"))
    bases = sizes.selectExpr("__kw_part", "sum(__kw_n) over (order by __kw_part rows between unbounded preceding and 1 preceding) as __kw_base")
    # one row per written partition, so the broadcast is bounded by the partition count
    return placed.join(F.broadcast(bases), "__kw_part").select(
        *quoted, (F.coalesce("__kw_base", F.lit(0)) + F.col("__kw_id").bitwiseAND((1 << 33) - 1)).alias(out)
    )
