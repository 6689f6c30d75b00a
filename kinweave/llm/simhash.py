"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within an even radius r have a common variant within r/2 bits
of each.  So every distinct fingerprint emits all variants in the ball of r/2
around it, the variants are shuffled, and fingerprints that meet are within r
of each other; the distance is verified all the same.  A variant can be met by
at most one ball of distinct fingerprints, so no group grows with the data, and
linking each to the least one in the group keeps every connection: all members
of a group are within r pairwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.llm.common import join_hot, without
from kinweave.operators.components import connected_components
from kinweave.storage import materialize, scratch

SEED = 42


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included, as uint64.

    A-Z is lower-cased, words are split at the six ASCII white-space
    characters, shingles are joined by spaces; fewer words than ``width`` give
    one shingle of them all, no words none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of ``hashes``; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def simhash(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text."""
    return majority(shingle_hashes(text, width))


def fingerprints(text: Column, width: int = 3) -> Column:
    """SimHash of each whole text as a long with the same 64 bits; null texts count as empty."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([simhash(t, width) for t in batch], np.uint64).view(np.int64))

    return of(text)


def ball_links(prints: DataFrame, radius: int = 2, bits: int = 64, group: tuple[str, ...] = ()) -> DataFrame:
    """(group..., a, b), a < b: links that connect just what distances up to ``radius`` connect.

    ``prints``: distinct (group..., fp).  Fingerprints of different groups do not meet.
    """
    if radius % 2 or radius < 0:
        raise ValueError("radius must be even: both sides emit variants within half of it")
    masks = [sum(1 << i for i in c) for r in range(radius // 2 + 1) for c in combinations(range(bits), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    variants = prints.withColumn("variant", F.explode(F.expr(f"transform(array({', '.join(f'{m}L' if m != -(1 << 63) else '(-9223372036854775807L - 1L)' for m in signed)}), m -> fp ^ m)")))
    least = F.min("fp").over(Window.partitionBy(*group, "variant"))
    met = variants.select(*group, "fp", least.alias("least")).where("fp <> least").select(*group, F.col("least").alias("a"), F.col("fp").alias("b"))
    return met.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def simhash_components(docs: DataFrame, radius: int = 2, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``fingerprint`` (16 hex digits) and ``component_id`` (least key reachable over links) to (key, other columns but the text).

    Links join fingerprints at ``radius`` differing bits or fewer; equal
    fingerprints are one node, so copies are never expanded into pairs.  Null
    and empty texts, and texts of white space, have fingerprint zero and link
    like any other.  A null key is never a component's least key unless all are
    null.  Rows with the same key but other texts are documents of their own;
    repeated rows are returned as often as they come.  Input columns with the
    names of the added ones are replaced.
    """
    docs = without(docs, "fingerprint", "component_id", "__kw_fp", "__kw_id", "__kw_n", "__kw_salt", "__kw_hot")
    rest = [c for c in docs.columns if c != text]
    with scratch() as scope:
        marked = scope.keep(docs.select(*[F.col(f"`{c}`") for c in rest], fingerprints(F.col(f"`{text}`"), width).alias("__kw_fp")), "simhash")
        nodes = materialize(marked.groupBy("__kw_fp").agg(F.min(F.col(f"`{key}`")).alias("__kw_id"), F.count(F.lit(1)).alias("__kw_n")), "simhash-nodes")
        parts = connected_components(ball_links(nodes.select(F.col("__kw_fp").alias("fp")), radius), "a", "b")
        rooted = nodes.join(parts, nodes["__kw_fp"] == parts["node"], "left").select("__kw_fp", "__kw_id", "__kw_n", F.coalesce("component", "__kw_fp").alias("root"))
        least = rooted.groupBy("root").agg(F.min("__kw_id").alias("component_id"))
        component = scope.keep(rooted.join(least, "root").select("__kw_fp", "component_id", "__kw_n"), "simhash-components")
    # fingerprint zero and the fingerprints of large groups of copies are hot keys
    return join_hot(marked, component, ["__kw_fp"], "__kw_n", marked.count()).select(
        *[F.col(f"`{c}`") for c in rest], F.lower(F.lpad(F.hex("__kw_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
