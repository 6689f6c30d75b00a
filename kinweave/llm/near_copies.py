"""Near-duplicate removal for a corpus: SimHash candidates, verified links, one document a class stays.

Candidates come from two sources.  Several short fingerprints over the distinct
words of a text, with independent bits, are each matched by ball hashing (see
``simhash``); the texts of fingerprints that balls connect are a candidate
group.  They bring copies together, but at a similarity of 0.8 a pair may be
missed, above all where a whole block was added or replaced.  So the MinHash
slots of the verified shingles are cut into bands of three, and the texts that
share a band are a candidate group too: whatever the edit, a pair of Jaccard
similarity J misses all 21 bands with a chance of (1 - J**3)**21, which is
3 in 10 million at 0.8.  Candidates are verified by the exact Jaccard similarity
of five-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.common import release_memory, slices_by_bytes, text_key, without
from kinweave.llm.minhash import signatures
from kinweave.llm.simhash import ball_links
from kinweave.llm.subword import split_words
from kinweave.llm.verify import shingle_sets, verified_links
from kinweave.operators.components import connected_components
from kinweave.storage import materialize, scratch

TABLES, BITS, RADIUS = 6, 40, 2
BANDS, BAND_SLOTS = 21, 3
_ODD = np.array([0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1E * t for t in range(TABLES)], object)
_TURN = np.array([int(x) | 1 for x in _ODD % (1 << 64)], np.uint64)


def word_prints(texts: pa.Array) -> np.ndarray:
    """(texts, TABLES) fingerprints of BITS bits over each text's distinct lower-cased words; 0 without words."""
    coded, first = split_words(texts, lower=True)
    base = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    code = coded.indices.to_numpy(zero_copy_only=False)
    out = np.zeros((len(texts), TABLES), np.int64)
    value = np.int64(1) << np.arange(BITS, dtype=np.int64)
    for i in range(len(texts)):
        own = np.unique(code[first[i] : first[i + 1]])
        if not len(own):
            continue
        for t in range(TABLES):
            with np.errstate(over="ignore"):
                h = base[own] * _TURN[t]
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(29)
            ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, count=BITS).sum(axis=0, dtype=np.int64)
            out[i, t] = value[ones * 2 > len(own)].sum()
    return out


def band_values(texts: pa.Array, width: int = 5) -> np.ndarray:
    """(texts, BANDS) values that texts share where all slots of a band are equal."""
    slots = signatures(texts, width)[:, : BANDS * BAND_SLOTS].reshape(len(texts), BANDS, BAND_SLOTS)
    out = np.zeros(slots.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(BAND_SLOTS):
            out = (out ^ slots[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _nodes(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, id, prints, bands) for every row; ``id`` stands for the text."""

    @F.pandas_udf("prints array<long>, bands array<long>")
    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = pa.array(batch, pa.string(), from_pandas=True)
            parts = [texts.slice(a, b - a) for a, b in slices_by_bytes(texts, 2 << 20)]
            yield pd.DataFrame({"prints": [row for p in parts for row in word_prints(p)], "bands": [row for p in parts for row in band_values(p, width)]})
        release_memory()

    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    name = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in text_key(own)])
    rows = docs.select(F.col(f"`{key}`").alias("key"), name.alias("id"), marks(own).alias("marks"))
    return materialize(rows.select("key", "id", "marks.prints", "marks.bands"), "near-nodes")


def near_copy_classes(docs: DataFrame, similarity: float = 0.8, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, root): texts that have a near copy, by text name, and a name for their class."""
    return _classes(docs, _nodes(docs, key, text, width), similarity, width, text)


def _classes(docs: DataFrame, nodes: DataFrame, similarity: float, width: int, text: str) -> DataFrame:
    prints = nodes.select("id", F.posexplode("prints").alias("t", "fp")).distinct()
    heads = prints.select("t", "fp").distinct()
    spot = F.concat_ws(":", "t", "fp")
    # fingerprints that balls connect are one candidate group, however many texts they have
    near = ball_links(heads, RADIUS, BITS, ("t",)).select(F.concat_ws(":", "t", "a").alias("a"), F.concat_ws(":", "t", "b").alias("b"))
    parts = connected_components(near, "a", "b")
    placed = prints.select("id", spot.alias("node")).join(parts, "node", "left").select("id", F.coalesce("component", "node").alias("g")).distinct()
    banded = nodes.select("id", F.posexplode("bands").alias("t", "h")).select("id", F.concat_ws(":", F.lit("band"), "t", "h").alias("g")).distinct()
    placed = materialize(placed.unionByName(banded), "near-placed")
    groups = materialize(placed.join(placed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g"), "g", "left_semi"), "near-groups")
    asked = groups.select("id").distinct()
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = docs.select(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in text_key(own)]).alias("id"), own.alias("text"))
    first = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    texts = named.join(asked, "id", "left_semi")
    if not first.where("n > 1").join(asked, "id", "left_semi").isEmpty():
        texts = texts.dropDuplicates(["id"])
    links = verified_links(groups, shingle_sets(texts, width), similarity)
    return connected_components(links, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("root"))


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, without later copies: of each class the row with the least key stays.

    Equal texts are copies; null texts count as empty, so of all rows without
    text one stays.  Null keys come last; of rows equal in key and text one
    stays.  An empty table stays empty; columns are kept.
    """
    with scratch() as scope:
        nodes = _nodes(docs, key, text, width)
        classes = _classes(docs, nodes, similarity, width, text)
        rooted = nodes.groupBy("id").agg(F.min("key").alias("key")).join(classes, "id", "left").withColumn("root", F.coalesce("root", "id"))
        least = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "id"))
        kept = scope.keep(rooted.groupBy("root").agg(least.alias("kept")).select("kept.key", "kept.id"), "near-kept")
        repeated = not nodes.groupBy("key", "id").count().where("count > 1").isEmpty()
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = without(docs, "__kw_id").select("*", F.concat(*[F.lpad(F.hex(c), 16, "0") for c in text_key(own)]).alias("__kw_id"))
    stay = marked.join(kept, (marked["__kw_id"] == kept["id"]) & marked[f"`{key}`"].eqNullSafe(kept["key"]), "left_semi")
    if repeated:
        stay = stay.dropDuplicates([key, "__kw_id"])
    return stay.drop("__kw_id")
