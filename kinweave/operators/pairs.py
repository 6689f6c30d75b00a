"""Joins between pair tables and record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_id(records: DataFrame, id_col: str = "rec_id", order: str | None = None) -> DataFrame:
    """One row for each id: the first in the given column's order, or any if the rows are alike."""
    if order is None:
        return records.dropDuplicates([id_col])
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(order))
    return records.withColumn("_r", rank).where("_r = 1").drop("_r")


def attach(pairs: DataFrame, records: DataFrame, columns: list[str], id_col: str = "rec_id") -> DataFrame:
    """Adds ``<column>_l`` and ``<column>_r`` of both records; missing ids give nulls."""
    r = records.select(id_col, *columns)
    left = r.withColumnsRenamed({id_col: "id_a", **{c: f"{c}_l" for c in columns}})
    right = r.withColumnsRenamed({id_col: "id_b", **{c: f"{c}_r" for c in columns}})
    return pairs.join(left, "id_a", "left").join(right, "id_b", "left")


def interleaved(pairs: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """As ``attach`` with each field's two sides next to each other."""
    both = attach(pairs, records, columns)
    rest = [c for c in pairs.columns if c not in ("id_a", "id_b")]
    return both.select("id_a", "id_b", *rest, *[x for c in columns for x in (f"{c}_l", f"{c}_r")])


def minus(pairs: DataFrame, done: DataFrame) -> DataFrame:
    return pairs.join(done.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")


def only(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    return pairs.join(chosen.select("id_a", "id_b"), ["id_a", "id_b"], "left_semi")


def both_sides(pairs: DataFrame, ids: list[str]) -> DataFrame:
    return pairs.where(F.col("id_a").isin(ids) & F.col("id_b").isin(ids))


def either_side(pairs: DataFrame, ids: list[str]) -> DataFrame:
    return pairs.where(F.col("id_a").isin(ids) | F.col("id_b").isin(ids))


def exact_pair(pairs: DataFrame, a: str, b: str) -> DataFrame:
    lo, hi = sorted((a, b))
    return pairs.where((F.col("id_a") == lo) & (F.col("id_b") == hi))


def canonical(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id_a, id_b) with id_a < id_b; pairs of one id with itself are dropped."""
    return pairs.select(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).where(F.col(a) != F.col(b))


def missing_ids(pairs: DataFrame, records: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """Ids of pairs that no record has; must be empty for a covered pair table."""
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias(id_col)).distinct()
    return ids.join(records.select(id_col), id_col, "left_anti")


def with_flags(labels: DataFrame, **tables: DataFrame) -> DataFrame:
    """Adds one boolean per table: whether it holds the pair."""
    out = labels
    for name, table in tables.items():
        flag = table.select("id_a", "id_b").distinct().withColumn(name, F.lit(True))
        out = out.join(flag, ["id_a", "id_b"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def last_per_pair(rows: DataFrame, *order: str) -> DataFrame:
    """The last row of each pair in the order of the given columns."""
    rank = F.row_number().over(Window.partitionBy("id_a", "id_b").orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def hash_sample(rows: DataFrame, by: str, n: int, seed: str) -> DataFrame:
    """The first ``n`` pairs of each stratum in the order of SHA-256 of pair and seed: the same on any engine."""
    order = F.sha2(F.concat_ws("|", "id_a", "id_b", F.lit(seed)), 256)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, "id_a", "id_b"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def split_by_hash(rows: DataFrame, by: Column, fraction: float, seed: str) -> DataFrame:
    """Adds ``part``: 'test' for about ``fraction`` of each class by hash order, 'train' for the rest."""
    order = F.sha2(F.concat_ws("|", "id_a", "id_b", F.lit(seed)), 256)
    rank = F.percent_rank().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("part", F.when(rank < fraction, "test").otherwise("train"))
