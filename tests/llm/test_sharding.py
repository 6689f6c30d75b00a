import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kinweave.llm.common import global_row_numbers
from kinweave.llm.sharding import Feistel, shard_rows


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 5))
def test_feistel_is_a_permutation(n, seed):
    f = Feistel(n, seed)
    assert sorted(map(f, range(n))) == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_sql_equals_python(spark, n):
    f = Feistel(n, 3)
    assert [r[0] for r in spark.range(n).select(F.expr(f.sql("id"))).orderBy("id").collect()] == [f(i) for i in range(n)]


def rows(spark):
    data = [(i % 50, f"t{i}", 7) for i in range(200)] + [(3, "same", 1)] * 90 + [(None, None, 0), (None, None, 0), (60, "", 2)]
    return spark.createDataFrame(data, "doc_id long, text string, slot int")


def test_law_rows(spark):
    got = shard_rows(rows(spark), ["doc_id"], 7).collect()
    assert len(got) == 293
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert set(by) == set(range(7))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    f = Feistel(293)
    assert all((f(r["row_no"]) % 7, f(r["row_no"]) // 7) == (r["shard"], r["slot"]) for r in got)


def test_same_result_whatever_the_partitioning(spark):
    place = lambda df: sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in shard_rows(df, ["doc_id"], 5).collect())
    assert place(rows(spark)) == place(rows(spark).repartition(9))


def test_row_numbers_follow_the_key(spark):
    got = sorted(global_row_numbers(rows(spark), ["doc_id"]).collect(), key=lambda r: r["row_no"])
    assert [r["row_no"] for r in got] == list(range(293))
    keys = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got]
    assert keys == sorted(keys)


def test_edges(spark):
    assert shard_rows(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"], 3).collect() == []
    one = shard_rows(spark.createDataFrame([(1, "a")], "doc_id long, Shard string"), ["doc_id"], 24).collect()
    assert [(r["shard"], r["slot"]) for r in one] == [(0, 0)]
    with pytest.raises(ValueError):
        shard_rows(one and spark.range(1), ["id"], 0)
