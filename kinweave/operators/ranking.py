"""Global ranks without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinweave.storage import materialize, shuffle_partitions


def global_rank(df: DataFrame, order: list[str], out: str, gapless: bool = True) -> DataFrame:
    """Adds ranks 1..n in the given total order: range partitions, sorted, with offsets.

    The sorted rows are written once, because range borders come from a sample.
    Ranks that may have gaps need no offsets, so nothing is counted or joined.
    """
    spread = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    if not gapless:
        return materialize(spread.withColumn(out, F.monotonically_increasing_id()), "rank")
    placed = materialize(spread.withColumn("_id", F.monotonically_increasing_id()), "rank").withColumn("_part", F.shiftright("_id", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    bases = sizes.selectExpr("_part", "coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _base")
    # one row per written partition: bounded by the partition count
    ranked = placed.join(F.broadcast(bases), "_part").withColumn(out, F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1)
    return ranked.drop("_part", "_base", "_id")
