"""Every query with SQL gives what DuckDB gives, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    assert rows(entry.queries()[name](spark, FOLDER).toPandas()) == rows(duck.execute(ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries())


def test_contributions_of_every_pair(spark):
    from kinweave.plans.rule_queries import candidates

    _, c = candidates(spark, FOLDER)
    pairs = [tuple(r) for r in c.select("id_a", "id_b").distinct().collect()]
    got = entry.queries()["op_m14_contributions"](spark, FOLDER).select("id_a", "id_b").distinct().collect()
    assert max(a for a, _ in pairs) >= "R00001000"
    assert {tuple(r) for r in got} == set(pairs)
