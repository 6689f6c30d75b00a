"""Candidate groups of texts to verified links, by exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kinweave.llm.common import join_hot, release_memory, slices_by_bytes
from kinweave.llm.shingles import shingles
from kinweave.operators.components import connected_components
from kinweave.storage import Stored

SMALL_GROUP = 24


def shingle_sets(texts: DataFrame, width: int = 5) -> DataFrame:
    """(id, s): the sorted distinct 64-bit hashes of the word shingles of every (id, text), written to the shared folder.

    Words are lower-cased and split at ASCII white space, as candidates are;
    fewer words than ``width`` are one shingle, no words none.
    """

    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            own = pa.array(batch, pa.string(), from_pandas=True)
            out = []
            for at, to in slices_by_bytes(own, 2 << 20):
                hashes, count = shingles(own.slice(at, to - at), width)
                ends = np.cumsum(count)
                out += [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(ends - count, ends)]
            yield pd.Series(out, dtype=object)
        release_memory()

    return Stored(texts.select("id", sets("text").alias("s")), "sets").df


def verify_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ok): whether the sets of each distinct pair reach the Jaccard similarity; two empty sets do."""
    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    na, nb, k = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    near = F.least(na, nb) >= F.greatest(na, nb) * similarity - 1e-9
    return both.select("a", "b", F.when(near, k >= (na + nb - k) * similarity - 1e-9).otherwise(False).alias("ok"))


class _Shared:
    """What the shingle sets of the members of large groups have in common.

    ``sizes``: (id, n, c), the size of each set and how many of its shingles
    occur in another member too.  Two members share min(c) shingles at most, so
    a similarity of t needs min(c) * (1 + t) >= t * (n + n'): a text that shares
    too little with any other needs no comparison at all.
    """

    def __init__(self, members: DataFrame, sets: DataFrame, similarity: float):
        self.similarity = similarity
        own = sets.join(members, "id", "left_semi").select("id", F.size("s").alias("n"), F.explode_outer("s").alias("x"))
        frequency = own.groupBy("x").agg(F.count(F.lit(1)).alias("f")).where("f > 1 and x is not null")
        counted = own.join(frequency, "x", "left").withColumn("common", F.col("f").isNotNull().cast("int"))
        self.shingles = Stored(counted.where("common = 1").select("id", "n", "x", "f"), "shingles").df
        common = self.shingles.groupBy("id").agg(F.count(F.lit(1)).alias("c"))
        sizes = sets.join(members, "id", "left_semi").select("id", F.size("s").alias("n")).join(common, "id", "left")
        self.sizes = Stored(sizes.select("id", "n", F.coalesce("c", F.lit(0)).alias("c")), "sizes").df

    def possible(self, c: F.Column, n: F.Column, other: F.Column) -> F.Column:
        """Whether a set of n with c common shingles can be similar to one of size ``other`` or more."""
        return c * (1 + self.similarity) + 1e-9 >= (n + other) * self.similarity

    def pairs(self, left: DataFrame, classes: DataFrame) -> DataFrame:
        """(a, b): candidates between ``left`` and all members by prefix filtering, exact for any data.

        ``classes``: (node, component) of the links known so far; members these
        connect are no candidates, and a shingle of one class only is not joined.

        Two sets of Jaccard similarity t share an element among the first
        n - ceil(t n) + 1 of either, in any common order.  In the order of
        rising frequency these are the rarest shingles, those of one text alone
        first, so texts that merely descend from one original rarely meet.  Of
        the elements from their first common one on, no more than the shorter
        rest can be shared, which drops a pair whose first is too late.
        """
        placed = self.shingles.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("f", "x"))).join(self.sizes.select("id", "c"), "id")
        need = F.col("n") - F.ceil(F.col("n") * self.similarity - 1e-9) + 1
        rest = F.col("c") - F.col("place")
        rows = placed.where(F.col("place") <= need - (F.col("n") - F.col("c"))).select("id", "n", "c", "x", rest.alias("r"))
        named = rows.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        prefix = Stored(named, "prefixes").df
        mixed = prefix.groupBy("x").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("x")
        prefix = Stored(prefix.join(mixed, "x", "left_semi"), "prefixes").df
        asked = prefix.join(left.select("id").distinct(), "id", "left_semi")
        i = asked.select(F.col("id").alias("i"), F.col("n").alias("ni"), F.col("c").alias("ci"), F.col("r").alias("ri"), F.col("component").alias("hi"), "x")
        j = prefix.select(F.col("id").alias("j"), F.col("n").alias("nj"), F.col("c").alias("cj"), F.col("r").alias("rj"), F.col("component").alias("hj"), "x")
        close = (F.least("ni", "nj") >= F.greatest("ni", "nj") * self.similarity - 1e-9) & self.possible(F.least("ci", "cj"), F.col("ni"), F.col("nj")) & self.possible(1 + F.least("ri", "rj"), F.col("ni"), F.col("nj"))
        return i.join(j, "x").where("hi <> hj").where(close).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


def verified_links(groups: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(a, b) links that connect what pairs of similar texts within the candidate groups connect.

    ``groups``: (g, id), distinct; ``sets``: see ``shingle_sets``, one row per
    id.  In a group of up to SMALL_GROUP members all pairs are verified.  A larger one is a star: every member is
    verified against the one with the largest share of common shingles, the
    likely original.  A member that is not similar to it, but shares enough
    with the others to be similar to any, goes on, in a star again as long as
    at least a tenth of the group was similar.  Every member that failed any
    centre, later centres and those similar to one included, is then compared
    by prefix filtering with all members of large groups that the links so far
    do not connect to it.  So a group of thousands of copies takes as many
    comparisons as it has members, and no link is lost: of two similar members
    either both are similar to the first centre and linked through it, or one
    failed it and is compared with the other.  Sets without shingles are equal.
    """
    state = Stored(groups, "groups").df
    n_of = state.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.count(F.lit(1)).alias("members")).where("k > 1")
    sized = join_hot(state, n_of, ["g"], "members", state.count())
    small = sized.where(F.col("k") <= SMALL_GROUP).select("g", "id")
    asked = small.select("g", F.col("id").alias("a")).join(small.select("g", F.col("id").alias("b")), "g").where("a < b").select("a", "b")
    found = [Stored(verify_pairs(asked.distinct(), sets, similarity), "verified").df.where("ok").select("a", "b")]
    large = Stored(sized.where(F.col("k") > SMALL_GROUP).select("g", "id"), "groups").df
    if not large.isEmpty():
        found += _large_groups(large, sets, similarity, found[0])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _large_groups(large: DataFrame, sets: DataFrame, similarity: float, known: DataFrame) -> list[DataFrame]:
    """Links within the large groups; ``known``: (a, b) links of the small ones."""
    shared = _Shared(Stored(large.select("id").distinct(), "members").df, sets, similarity)
    empty = shared.sizes.where("n = 0").select("id")
    # one row in all: the least text without shingles
    found = [empty.join(F.broadcast(empty.agg(F.min("id").alias("a"))), F.col("id") > F.col("a")).select("a", F.col("id").alias("b"))]
    members = large.join(shared.sizes.where("n > 0"), "id")
    # the least size of the whole group: a partner may have found its centre rounds ago
    least = members.groupBy("g").agg(F.min("n").alias("least_n"), F.count(F.lit(1)).alias("members"))
    total = large.count()
    state = Stored(join_hot(members, least, ["g"], "members", total), "stars").df
    waiting = None
    while True:
        centre = F.max(F.struct((F.col("c") / F.col("n")).alias("share"), "id"))
        heads = state.groupBy("g").agg(centre.alias("top"), F.count(F.lit(1)).alias("k")).select("g", F.col("top.id").alias("head"), "k", F.col("k").alias("members"))
        arms = Stored(join_hot(state, heads, ["g"], "members", total).where("id <> head"), "arms").df
        asked = arms.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
        checked = Stored(verify_pairs(asked, sets, similarity), "verified").df
        found.append(checked.where("ok").select("a", "b"))
        no = checked.where("not ok").select("a", "b")
        failed = arms.withColumns({"a": F.least("id", "head"), "b": F.greatest("id", "head")}).join(no, ["a", "b"], "left_semi")
        stop = failed.groupBy("g").agg((F.count(F.lit(1)) > F.first("k") * 0.9).alias("stop"), F.count(F.lit(1)).alias("members"))
        open_ = failed.where(shared.possible(F.col("c"), F.col("n"), F.greatest(F.col("least_n"), F.col("n") * similarity)))
        rest = Stored(join_hot(open_, stop, ["g"], "members", total).select("g", "id", "n", "c", "least_n", "stop"), "stars").df
        # whoever is in a later star failed the first one, so the first round names all
        if waiting is None:
            waiting = Stored(rest.select("id").distinct(), "left").df
        state = rest.where("not stop").drop("stop")
        if state.isEmpty():
            break
    if not waiting.isEmpty():
        links = known
        for more in found:
            links = links.unionByName(more)
        classes = connected_components(links, "a", "b")
        found.append(verify_pairs(shared.pairs(waiting, classes), sets, similarity).where("ok").select("a", "b"))
    return found
