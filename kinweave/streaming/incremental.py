"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators.index import IndexStore, score_batch, upsert


def score_stream(records: DataFrame, store: IndexStore, cleaned: DataFrame, checkpoint: str) -> StreamingQuery:
    """Scores a stream of cleaned records batch by batch against the index and commits every batch.

    A batch that is replayed after a failure changes nothing: its records are
    indexed already and lead to the same entities.  ``cleaned`` holds the
    records of the index so far; late data does not matter, because the final
    partition does not depend on the order of records.
    """
    seen = {"records": cleaned}

    def step(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["rec_id"])
        members, postings = score_batch(new, seen["records"].join(new.select("rec_id"), "rec_id", "left_anti"), store.read("members"), store.read("postings"))
        store.commit(members=members, postings=postings)
        seen["records"] = upsert(seen["records"], new, ["rec_id"])

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window start, event_type, n, total): windowed counts with a watermark, for streams and tables alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", lateness) if events.isStreaming else rows
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
