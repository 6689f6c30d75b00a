"""The corpus pipeline: quality, near copies, benchmark leaks, mixing, sharding.

Every stage takes null and empty texts, null keys, repeated rows, texts of any
length and empty tables: texts without words share one quality score and are
copies of each other, so one of them stays at most; rows equal in key and text
are one document until the mix; null sources are a source; the shards number
all rows that are left.  Columns keep their names whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm.common import read_table, text_or_empty
from kinweave.llm.decontaminate import drop_contaminated
from kinweave.llm.mixing import Target, mixed_documents
from kinweave.llm.near_copies import drop_near_copies
from kinweave.llm.quality import keep_quality
from kinweave.llm.sharding import shard_rows
from kinweave.storage import scratch

SHARDS = 24
MIX = Target(repeats=2.0)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays."""
    return drop_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of small sources come up to twice; every document stays."""
    return mixed_documents(docs, MIX)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row, repeats included; the text is named by its checksum."""
    text = text_or_empty(F.col("text"))
    rows = docs.select("doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows, ["doc_id"], SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("leaks", leaks),
    ("mixing", mixing),
    ("sharding", sharding),
]

ORACLE_SQL = None  # the classifier and the similarity of whole texts have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote on its way goes with it, its input after it."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as scope:
            docs = scope.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.drop()
        before = scope.kept[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
