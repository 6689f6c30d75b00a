import random

import pytest

from kinweave.llm import common
from kinweave.llm.line_dedup import dedup_lines


def brute(docs, m, words):
    """docs: sorted (id, text) -> {id: (kept text, deleted, runs, longest)}; every place is compared with every earlier one."""
    texts = [(k, [] if t is None else t.split("\n")) for k, t in docs]
    places = [(n, i) for n, (_, lines) in enumerate(texts) for i in range(len(lines))]
    out = {}
    for n, (k, lines) in enumerate(texts):
        spans = []
        for i in range(len(lines)):
            longest = 0
            for o, j in places:
                if (o, j) >= (n, i):
                    break
                other, length = texts[o][1], 0
                while i + length < len(lines) and j + length < len(other) and lines[i + length] == other[j + length]:
                    length += 1
                longest = max(longest, length)
            if longest >= m and any(x.strip() for x in lines[i : i + longest]):
                spans.append((i, i + longest))
            elif longest and len(lines[i].split()) >= words:
                spans.append((i, i + 1))
        spans = [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)]
        gone = {i for a, b in spans for i in range(a, b)}
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[k] = (None if docs[n][1] is None else kept, len(gone), len(spans), max((b - a for a, b in spans), default=0))
    return out


def result(df, m, words):
    return {r["doc_id"]: (r["text"], r["n_deleted"], r["n_runs"], r["longest_run"]) for r in dedup_lines(df, min_lines=m, min_words=words).collect()}


@pytest.mark.parametrize("m", [2, 3, 5])
def test_against_brute_force(spark, monkeypatch, m):
    if m == 3:  # every repeated line is a hot key
        monkeypatch.setattr(common, "HOT_LEAST", 1)
        monkeypatch.setattr(common, "HOT_SHARE", 10**9)
    rng = random.Random(m)
    pool = ["a", "b", "c", "", "long line of words", "x y"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, docs[3][1]), (103, docs[3][1]), (104, "same\n" * 40), (105, "\n\n\n\nb\nx y"), (106, "c\n\n\n\n\nb\nx y")]
    docs += [(110, docs[7][1] + "\n" + docs[9][1] + "\n" + docs[11][1]), (111, docs[9][1] + "\n" + docs[11][1])]
    df = spark.createDataFrame([(k, t, 9) for k, t in docs], "doc_id long, text string, N_LINES int")
    assert result(df, m, 4) == brute(docs, m, 4)


def test_long_repeats_at_every_length(spark):
    """Lengths that are no powers of two, shared with members that are not the first of their interval."""
    lines = [f"l{i}" for i in range(40)]
    docs = [(0, "\n".join(lines[:9] + ["u"])), (1, "\n".join(lines[:23] + ["v"])), (2, "\n".join(lines[:31] + ["w"])), (3, "\n".join(["s"] + lines[:22] + ["x"] + lines[2:40])), (4, "\n".join(lines[5:37]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 2, 25)
    assert result(df, 2, 25) == want and want[3][2:] == (2, 29) and want[4][2:] == (1, 32)


def test_runs_of_two_documents_side_by_side(spark):
    docs = [(1, "A\nB"), (2, "C\nD"), (3, "A\nB\nC\nD")]
    assert result(spark.createDataFrame(docs, "doc_id long, text string"), 2, 25)[3] == ("", 4, 2, 2)


def test_repeated_rows_and_null_keys(spark):
    rows = [(1, "p\nq\nr")] * 3 + [(None, "p\nq\nz"), (2, "p\nq\nr")]
    got = sorted((str(r["doc_id"]), r["text"], r["n_runs"], r["longest_run"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "r", 1, 2)] * 3 + [("2", "", 1, 3), ("None", "p\nq\nz", 0, 0)]
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert dedup_lines(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["n_lines"] == 0


def test_levels_broadcast_nothing(spark):
    """Only hot keys are broadcast, so what the driver holds does not grow with the levels."""
    from kinweave.llm import line_dedup

    lines = spark.createDataFrame([(d, i, 1000 * (d // 2) + i, 0, True) for d in range(8) for i in range(30)], "doc long, line int, h1 long, h2 long, any boolean")
    levels = line_dedup._levels(lines, 240)
    assert [most for _, most in levels] == [2] * 5
    found = line_dedup._copies(levels, 240)
    assert sorted((r.doc, r.line, r.length) for r in found.collect()) == [(d, i, 30 - i) for d in (1, 3, 5, 7) for i in range(30)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    narrow = spark.range(4).selectExpr("id as k", "2 as members")
    assert "Broadcast" not in common.join_hot(spark.range(9).selectExpr("id as k"), narrow, ["k"], "members", 9, most=2)._jdf.queryExecution().executedPlan().toString()
