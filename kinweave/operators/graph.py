"""Operators on the pair graph: weights, pruning, clusters, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kinweave.operators.components import connected_components

TOP_K, QGRAM_WEIGHT = 10, 0.5


def arcs_weights(pairs: DataFrame, lone_qgram: float = QGRAM_WEIGHT, sizes: DataFrame | None = None) -> DataFrame:
    """Adds ``weight``: the sum over a pair's blocks of 1 / pairs in that block; a fixed weight for pairs only the q-gram block finds.

    ``sizes``: (block, n) where it is known; else the pairs are counted.
    """
    if sizes is None:
        sizes = pairs.select(F.explode("blocks").alias("block")).where("block <> 'QG'").groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    # one row with an entry for each block scheme: a handful, so the pairs are not shuffled
    shares = sizes.agg(F.map_from_entries(F.collect_list(F.struct("block", 1 / F.col("n")))).alias("_share"))
    known = F.filter("blocks", lambda b: b != "QG")
    weight = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, b: s + F.element_at("_share", b))).otherwise(lone_qgram)
    return pairs.crossJoin(F.broadcast(shares)).withColumn("weight", weight).drop("_share")


def prune_top_k(weighted: DataFrame, k: int = TOP_K) -> DataFrame:
    """Keeps edges among the k heaviest of either end; ties go to the greater pair."""
    ends = weighted.select(F.explode(F.array("id_a", "id_b")).alias("node"), *weighted.columns)
    order = Window.partitionBy("node").orderBy(F.col("weight").desc(), F.col("id_a").desc(), F.col("id_b").desc())
    # the pairs come along, so they are made once and only kept ones are made distinct
    return ends.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r", "node").dropDuplicates(["id_a", "id_b"])


def assign_clusters(ids: DataFrame, edges: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """(id, cluster_id) for all ids: linked clusters numbered densely in the order of their least id, then singletons in id order."""
    from kinweave.operators.ranking import global_rank

    known = ids.select(F.col(id_col).alias("id")).distinct()
    own = edges.join(known.withColumnRenamed("id", "id_a"), "id_a", "left_semi").join(known.withColumnRenamed("id", "id_b"), "id_b", "left_semi")
    parts = connected_components(own, "id_a", "id_b").withColumnRenamed("node", "id")
    rooted = known.join(parts, "id", "left").withColumn("root", F.coalesce("component", "id")).withColumn("lone", F.col("component").isNull())
    roots = global_rank(rooted.groupBy("root").agg(F.min(F.col("lone").cast("int")).alias("lone")), ["lone", "root"], "cluster_id").withColumn("cluster_id", F.col("cluster_id") - 1)
    return rooted.join(roots.select("root", "cluster_id"), "root").select("id", "cluster_id")


def two_hop_pairs(pairs: DataFrame, least: int = 2, most: int = 40) -> DataFrame:
    """New pairs whose ends share a neighbour of moderate degree."""
    both = pairs.select(F.col("id_a").alias("bridge"), F.col("id_b").alias("end")).unionByName(pairs.select(F.col("id_b").alias("bridge"), F.col("id_a").alias("end")))
    degree = both.groupBy("bridge").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))
    arms = both.join(degree, "bridge", "left_semi")
    met = arms.withColumnRenamed("end", "id_a").join(arms.withColumnRenamed("end", "id_b"), "bridge").where("id_a < id_b").select("id_a", "id_b").distinct()
    return met.join(pairs.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")


def degrees(pairs: DataFrame) -> DataFrame:
    """(node, degree)"""
    return pairs.select(F.explode(F.array("id_a", "id_b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_summary(pairs: DataFrame) -> DataFrame:
    """(nodes, mean, median, p99, max, hubs): exact percentiles of the degree, and nodes of degree over 50."""
    d = degrees(pairs)
    return d.agg(
        F.count(F.lit(1)).alias("nodes"), F.avg("degree").alias("mean"), F.percentile("degree", 0.5).alias("median"), F.percentile("degree", 0.99).alias("p99"),
        F.max("degree").alias("max"), F.sum((F.col("degree") > 50).cast("long")).alias("hubs"),
    )


def expand_components(clusters: DataFrame) -> DataFrame:
    """All pairs inside each cluster (id, cluster_id)."""
    a, b = clusters.withColumnRenamed("id", "id_a"), clusters.withColumnRenamed("id", "id_b")
    return a.join(b, "cluster_id").where("id_a < id_b").select("id_a", "id_b")


def external_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs with exactly one end in a set of members (id)."""
    m = members.select("id").distinct().withColumn("in", F.lit(True))
    a, b = m.withColumnsRenamed({"id": "id_a", "in": "in_a"}), m.withColumnsRenamed({"id": "id_b", "in": "in_b"})
    both = pairs.join(a, "id_a", "left").join(b, "id_b", "left")
    return both.where(F.coalesce("in_a", F.lit(False)) != F.coalesce("in_b", F.lit(False))).drop("in_a", "in_b")


def merge_paths(clusters: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """(cluster_id, id_a, id_b, path, hops): a shortest chain of edges between any two members of a cluster.

    Clusters of over ``most`` members are left out.  One breadth-first search
    for each member, cluster by cluster; neighbours are visited in id order.
    """
    import pandas as pd

    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most))
    c = clusters.join(sizes, "cluster_id", "left_semi")
    inside = edges.select("id_a", "id_b").join(c.withColumnRenamed("id", "id_a"), "id_a")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for a, b in zip(frame["id_a"], frame["id_b"]):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        near = {k: sorted(set(v)) for k, v in near.items()}
        rows = []
        for source in sorted(near):
            parent, queue = {source: None}, [source]
            for node in queue:
                for other in near[node]:
                    if other not in parent:
                        parent[other] = node
                        queue.append(other)
            for node in sorted(parent):
                if node > source:
                    path, at = [], node
                    while at is not None:
                        path.append(at)
                        at = parent[at]
                    rows.append((frame["cluster_id"].iloc[0], source, node, path[::-1], len(path) - 1))
        return pd.DataFrame(rows, columns=["cluster_id", "id_a", "id_b", "path", "hops"])

    return inside.groupBy("cluster_id").applyInPandas(search, "cluster_id long, id_a string, id_b string, path array<string>, hops int")
