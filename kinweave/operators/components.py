"""Connected components of an edge table.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Every step is one aggregation and
one equi-join on the node, so a hub is pre-aggregated before the shuffle and its
join partition can be split by adaptive execution.  The number of rounds grows
with the logarithm of the component size, not with the diameter.  Each round is
written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from kinweave.storage import Stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b): neighbours move to the least neighbour of each node."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    Edges are undirected.  Null ends and self-loops are dropped, repeated edges
    count once, an empty table gives an empty table, other columns are ignored.
    Nodes of any orderable type.  Raises if ``max_rounds`` rounds do not settle.
    """
    start = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    state = Stored(start.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        large = Stored(_star(state.df, large=True), "cc")
        small = Stored(_star(large.df, large=False), "cc")
        large.drop()
        state.drop()
        state = small
        now = small.df.agg(
            F.count(F.lit(1)),
            F.expr("bit_xor(xxhash64(a, b))"),
            F.expr("coalesce(sum(cast(xxhash64(b, a) as decimal(38, 0))), 0)"),
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = state.df.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = star.select(F.col("component").alias("node"), "component").distinct()
    return star.unionByName(roots)


def spanning_edges(edges: DataFrame, src: str, dst: str, sums: tuple[str, ...] = (), nodes: int = 500_000) -> DataFrame:
    """Edges (src, dst) with the components of all edges, and totals of number columns, in one pass over edges that are not written.

    Each task joins the ends it sees and passes on only edges that join
    something, so they are fewer than its nodes, however many its edges.  Once
    it holds ``nodes`` of them it forgets all and starts anew, which passes on
    more edges but no other components.  ``sums`` and the count ``n`` are in
    one row for each task, whose ends are null.
    """
    ends = [T.StructField(f.name, f.dataType) for f in edges.select(src, dst).schema]
    out = T.StructType([*ends, T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in sums]])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        n, total = 0, dict.fromkeys(sums, 0.0)

        def root(x):
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        def row_group(left: list, right: list, count: list, totals: dict[str, list]) -> pa.RecordBatch:
            kinds = [batch.schema.field(src).type, batch.schema.field(dst).type]
            return pa.RecordBatch.from_arrays([pa.array(left, kinds[0]), pa.array(right, kinds[1]), pa.array(count, pa.int64()), *[pa.array(totals[c], pa.float64()) for c in sums]], [src, dst, "n", *sums])

        for batch in batches:
            left, right = [], []
            for a, b in zip(batch.column(src).to_pylist(), batch.column(dst).to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    above[y] = x
                    left.append(a)
                    right.append(b)
            n += batch.num_rows
            for c in sums:
                total[c] += pc.sum(batch.column(c).cast(pa.float64())).as_py() or 0.0
            if left:
                none = [None] * len(left)
                yield row_group(left, right, none, dict.fromkeys(sums, none))
            if len(above) > nodes:
                above.clear()
        if n:
            yield row_group([None], [None], [n], {c: [x] for c, x in total.items()})

    return edges.select(src, dst, *sums).mapInArrow(thin, out)
