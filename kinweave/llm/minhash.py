"""MinHash document fingerprints in vectorised numpy, banded near-duplicates in Spark.

A text is its set of word shingles.  Every shingle hash x is permuted by SLOTS
functions a*x + b mod 2**64 with odd a; a slot keeps the least value over the
shingles.  The probability that two texts agree in a slot is the Jaccard
similarity of their sets.  A fingerprint stores 16 mixed bits of each slot.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.common import join_hot, slices_by_bytes, text_key
from kinweave.llm.shingles import SHINGLE, mixed, shingles
from kinweave.llm.verify import shingle_sets, verified_links
from kinweave.operators.components import connected_components
from kinweave.storage import materialize, scratch, shuffle_partitions

SLOTS = 64
_rng = np.random.default_rng(20_000_003)
_A = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(texts: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """(texts, SLOTS) uint64 minima; all bits set for a text without words."""
    hashes, count = shingles(texts, width)
    out = np.full((len(texts), SLOTS), _EMPTY, np.uint64)
    some = np.nonzero(count)[0]
    if len(some):
        starts = (np.cumsum(count) - count)[some]
        step = 1 << 16
        with np.errstate(over="ignore"):
            if len(hashes) <= step:
                for s in range(SLOTS):
                    out[some, s] = np.minimum.reduceat(hashes * _A[s] + _B[s], starts)
            else:  # a long text by pieces that stay in cache
                for lo in range(0, len(hashes), step):
                    part = hashes[lo : lo + step]
                    i, j = int(np.searchsorted(starts, lo, side="right")) - 1, int(np.searchsorted(starts, lo + len(part), side="left"))
                    cuts = np.maximum(starts[i:j] - lo, 0)
                    rows = some[i:j]
                    for s in range(SLOTS):
                        out[rows, s] = np.minimum(out[rows, s], np.minimum.reduceat(part * _A[s] + _B[s], cuts))
    return out


def prints(minima: np.ndarray) -> np.ndarray:
    """16 bits of every slot, mixed so that the small size of a minimum does not show; empty texts have all bits set."""
    with np.errstate(over="ignore"):
        short = (mixed(minima) >> np.uint64(48)).astype(np.uint16)
    short[minima == _EMPTY] = 0xFFFF
    return short


def _hex(short: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in short.astype(">u2")]


def edited(text: str, after: str) -> str:
    """The last third of the code points (rounded down) replaced by the first as many of ``after``."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k]


def _in_chains(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(place, ghost, key, text): descending key order cut into places, each followed by a ghost of the next place's first row.

    The borders are quantiles of the key, so a place is a bounded run of rows.
    A key that fills several quantiles (or null keys that would) is cut further
    by a hash of the text, which is also its order; only rows equal in key and
    text stay in one place, and they stream through it.
    """
    n = 4 * shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10_000), F.count_if(F.col("key").isNull()), F.count(F.lit(1))).first()
    often = Counter(found[0] or [])
    splits = [-float("inf"), *sorted({float(c) for c in often}), float("inf")]
    last = len(splits) - 2  # null keys come last of all
    # at most one row for each quantile
    hot = [(last - splits.index(float(c)), c, m) for c, m in often.items() if m > 1] + [(last + 1, None, max(1, n * found[1] // found[2]))]
    hot = docs.sparkSession.createDataFrame(hot, "hot_place int, hot long, parts int")
    rows = rows.withColumn("as_double", F.col("key").cast("double"))
    placed = Bucketizer(splits=splits, inputCol="as_double", outputCol="bucket", handleInvalid="keep").transform(rows)
    placed = placed.select("key", "text", F.xxhash64("text").alias("h"), F.when(F.col("key").isNull(), last + 1).otherwise(last - F.col("bucket").cast("int")).alias("place"))
    placed = placed.join(F.broadcast(hot), F.col("place") == F.col("hot_place"), "left")
    part = ((F.shiftright("h", 32) + (1 << 31)) * F.col("parts")) / (1 << 32)
    part = F.when(F.col("parts").isNull() | (F.col("key") > F.col("hot")), 0).when(F.col("key") < F.col("hot"), F.col("parts") + 1).otherwise(1 + F.floor(part))
    placed = placed.select("key", "text", "h", (F.col("place").cast("long") * (n + 2) + part).alias("place"))
    # one row per place: bounded by the number of partitions; the first of a place has the greatest key, then the least hash
    first = F.max(F.struct("key", F.bitwise_not("h").alias("not_h"))).alias("first")
    heads = sorted(placed.groupBy("place").agg(first).collect(), key=lambda r: r["place"])
    ghosts = [(r["first"]["key"], ~r["first"]["not_h"], heads[i - 1]["place"]) for i, r in enumerate(heads)]
    ghosts = docs.sparkSession.createDataFrame(ghosts, "head long, head_h long, before long")
    marked = placed.join(F.broadcast(ghosts), placed["key"].eqNullSafe(ghosts["head"]) & (placed["h"] == ghosts["head_h"]), "left")
    both = F.array_compact(F.array(F.struct("place", F.lit(0).alias("ghost")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("place"), F.lit(1).alias("ghost")))))
    return marked.select("key", "text", F.explode(both).alias("at")).select("at.place", "at.ghost", "key", "text")


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document of each is the one behind it in descending key order
    (nulls last; equal keys by a hash of the text), after the last the first; a
    lone document is its own next.  Null texts count as empty.  Equal texts
    have equal fingerprints; texts without words have all bits set and are
    alike (1.0).  Repeated rows are returned as often as they come.  An empty
    table gives an empty table.  Other columns are not returned.
    """
    if docs.isEmpty():
        chains = docs.select(F.lit(0).cast("long").alias("place"), F.lit(0).alias("ghost"), F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    else:
        chains = _in_chains(docs, key, text)
    order = ["place", "ghost", F.col("key").desc_nulls_last(), F.xxhash64("text"), "text"]
    spread = chains.repartition(shuffle_partitions(docs.sparkSession), "place").sortWithinPartitions(*order)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        held = None
        for place, ghost, number, own in rows(batches):
            if held is not None and held[0] == place:
                yield held[1], held[2], own
            held = None if ghost else (place, number, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple[int | None, str, str]] = []
        size = 0
        for item in paired(batches):
            some.append(item)
            size += len(item[1])
            if size >= 2 << 20 or len(some) >= 4096:
                yield out(some)
                some, size = [], 0
        if some:
            yield out(some)

    def out(some: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        changed = [edited(own, after) for _, own, after in some]
        own = prints(signatures(pa.array([x[1] for x in some] + [some[-1][2]], pa.string())))
        after = own[1:].copy()
        apart = [i for i in range(len(some) - 1) if some[i][2] is not some[i + 1][1] and some[i][2] != some[i + 1][1]]
        if apart:
            after[apart] = prints(signatures(pa.array([some[i][2] for i in apart], pa.string())))
        new = prints(signatures(pa.array(changed, pa.string())))
        own = own[:-1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in some], pa.int64()), pa.array([len(x[1]) for x in some], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(_hex(own)), pa.array(_hex(new)),
                pa.array((own == new).mean(axis=1)), pa.array((own == after).mean(axis=1)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return spread.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("doc_id", key)


def minhash_classes(docs: DataFrame, bands: int = 16, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id): near-duplicate classes, class_id the least key of the class.

    Signatures are cut into bands; texts that share a band are verified by the
    exact Jaccard similarity of their five-word shingles (``verified_links``),
    and links are closed to components.  Equal texts are one candidate, so
    copies are never expanded.  Null texts count as empty.  Rows of equal key
    and text get the same class; an empty table gives an empty table.
    """
    if SLOTS % bands:
        raise ValueError(f"bands must divide {SLOTS}")
    known = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    known = known.select("key", "text", F.concat(*[F.lpad(F.hex(c), 16, "0") for c in text_key(F.col("text"))]).alias("id"))

    @F.pandas_udf("array<long>")
    def band_hashes(texts: pd.Series) -> pd.Series:
        own = pa.array(list(texts), pa.string())
        minima = np.concatenate([signatures(own.slice(a, b - a)) for a, b in slices_by_bytes(own, 2 << 20)] or [np.empty((0, SLOTS), np.uint64)])
        with np.errstate(over="ignore"):
            slots = mixed(minima).reshape(len(minima), bands, -1)
            got = np.zeros(slots.shape[:2], np.uint64)
            for j in range(slots.shape[2]):
                got = mixed(got * np.uint64(31) + slots[:, :, j])
        return pd.Series(list(got.view(np.int64)))

    with scratch() as scope:
        banded = materialize(known.select("id", F.posexplode(band_hashes("text")).alias("band", "h")).select(F.concat_ws(":", "band", "h").alias("g"), "id").distinct(), "bands")
        shared = banded.join(banded.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "g", "left_semi")
        groups = materialize(shared, "groups")
        asked = known.join(groups.select("id").distinct(), "id", "left_semi")
        links = verified_links(groups, shingle_sets(asked.groupBy("id").agg(F.min("text").alias("text"))), similarity)
        parts = connected_components(links, "a", "b")
        nodes = known.groupBy("id").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("members"))
        rooted = materialize(nodes.join(parts, nodes["id"] == parts["node"], "left").select("id", "key", "members", F.coalesce("component", "id").alias("root")), "classes")
        least = rooted.groupBy("root").agg(F.min("key").alias("class_id"))
        classes = scope.keep(rooted.join(least, "root").select("id", "members", "class_id"), "classes")
    total = classes.agg(F.sum("members")).first()[0] or 0
    return join_hot(known.select("key", "id"), classes, ["id"], "members", total).select(F.col("key").alias(key), "class_id")
