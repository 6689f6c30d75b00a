"""The pipeline on the smallest tables, each stage against a plain version of it on its own input."""

from collections import Counter

import corpus_pipeline
from kinweave.llm.common import read_table
from kinweave.llm.decontaminate import normal
from plain import jaccard
from plain import shingle_set
from kinweave.storage import materialize

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, FOLDER, "documents")
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, FOLDER, "labels").collect()}
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, FOLDER), name)
        rows = docs.collect()
        seen.append(name)
        if name != "sharding":
            assert docs.columns == columns
            assert all(before[r["doc_id"]] == r["text"] for r in rows)
        after = {r["doc_id"] for r in rows}
        if name == "quality":
            good, bad = [k for k in before if labels.get(k) == 1], [k for k in before if labels.get(k) == 0]
            assert sum(k in after for k in good) >= 0.9 * len(good) and sum(k in after for k in bad) <= 0.5 * len(bad)
        elif name == "near_copies":
            sets = {k: shingle_set(t, 5) for k, t in before.items()}
            keys, parent = sorted(before), {k: k for k in before}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i, a in enumerate(keys):
                for b in keys[:i]:
                    if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= 0.8:
                        x, y = sorted((find(a), find(b)))
                        parent[y] = x
            assert after == {k for k in before if find(k) == k}
        elif name == "leaks":
            items = [normal(r["text"]) for r in read_table(spark, FOLDER, "benchmark").collect()]
            exact = {k for k, t in before.items() if any(i in normal(t) for i in items)}
            assert not after & exact and len(before) - len(after) <= len(exact) + 2
        elif name == "mixing":
            assert after == set(before)
            assert max(Counter(r["doc_id"] for r in rows).values()) <= 2
        else:
            sizes = Counter(r["shard"] for r in rows)
            assert sum(sizes.values()) == len(kept) and max(sizes.values()) - min(sizes.values()) <= 1
        before, kept = {r["doc_id"]: r["text"] for r in rows} if name != "sharding" else {}, rows
    assert seen == ["quality", "near_copies", "leaks", "mixing", "sharding"]


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def edge_rows():
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    return [(1, "a b c d e f", "en", "s", 11, 0, "x"), (1, "a b c d e f", "en", "s", 11, 0, "x"), (2, None, None, None, None, None, None), (3, "", "en", "s", 0, 1, "y"), (4, "  ", "en", None, 2, 1, "y"), (None, "only here", "de", "t", 9, 2, "z"), (5, long, "en", "s", len(long), 3, "z"), (6, long + " end", "en", "t", len(long) + 4, 3, "z")]


def test_odd_rows_and_empty_tables(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns and no rows at all, in every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, shard int, __kw_n string"
    rows = edge_rows()
    kept = {}
    for docs, some in ((spark.createDataFrame(rows, schema), True), (spark.createDataFrame([], schema), False)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            got = out.collect()
            if some:
                kept[name] = sorted((str(r["doc_id"]) for r in got))
            else:
                assert got == []
            if name != "sharding":
                assert out.columns == docs.columns
    assert set(kept["quality"]) <= {str(r[0]) for r in rows}
    # of the copies of a text, of the near copies and of the texts without words the least key stays; a null key is an ordinary row
    assert kept["near_copies"] == ["1", "2", "5", "None"]
    assert kept["leaks"] == sorted(str(r[0]) for r in rows) and kept["sharding"] == kept["leaks"]
    assert Counter(kept["mixing"])["1"] >= 2 and set(kept["mixing"]) == {str(r[0]) for r in rows}
