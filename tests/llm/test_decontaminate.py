import random

import numpy as np

from kinweave.llm.decontaminate import Q, ItemIndex, _batches, banded_alignments, benchmark_matches, drop_contaminated, edit_budget, normal, points


def distance(item, text):
    p, t = normal(item), normal(text)
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def cases(rng):
    words = ["alpha", "beta", "gam", "delta", "eps", "zeta", "eta", "the", "of", "größe"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 22)))) for i in range(6)]
    texts = []
    for _ in range(6):
        around = [rng.choice(words) for _ in range(rng.randrange(0, 40))]
        item = list(rng.choice(items)[1])
        for _ in range(rng.randrange(0, 8)):
            p = rng.randrange(len(item)) if item else 0
            if not item or rng.random() < 0.3:
                item.insert(p, rng.choice("abcdefgh"))
            elif rng.random() < 0.5:
                del item[p]
            else:
                item[p] = rng.choice("abcdefgh")
        at = rng.randrange(len(around) + 1)
        texts.append(" ".join([*around[:at], "".join(item), *around[at:]]))
    return items, texts


def test_search_against_brute_force(monkeypatch):
    rng = random.Random(11)
    for trial in range(25):
        if trial == 12:
            monkeypatch.setattr("kinweave.llm.decontaminate.PIECE", 64)
        items, texts = cases(rng)
        index = ItemIndex(items, 0.1)
        got = {(n, i): (e, s, t) for n, i, e, s, t in index.search([points(normal(t)) for t in texts])}
        for n, text in enumerate(texts):
            for i, (_, item) in enumerate(items):
                size = len(normal(item))
                most = 0 if size < Q else edit_budget(size)
                best = distance(item, text)
                assert (best <= most) == ((n, i) in got), (item, text, best)
                if best <= most:
                    edits, start, end = got[n, i]
                    assert edits == best
                    assert distance(item, normal(text)[start:end]) == best


def test_tables(spark):
    item = "what is the capital of the ninth province of the realm"
    docs = [(1, f"noise {item.upper()}  noise"), (2, "clean text"), (3, None), (4, ""), (None, item), (5, item.replace("ninth", "nineth")), (5, item), (6, "x " * 5000 + item)]
    df = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, edits int")
    bench = spark.createDataFrame([(7, item, "z"), (8, None, "z"), (9, " ", "z"), (None, "clean text", "z")], "item_id long, text string, doc_id string")
    got = sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in benchmark_matches(df, bench).collect())
    assert got == [("1", 7, 0), ("5", 7, 0), ("5", 7, 1), ("6", 7, 0), ("None", 7, 0)]
    assert sorted(r["doc_id"] for r in drop_contaminated(df, bench).collect()) == [2, 3, 4]
    assert drop_contaminated(df, bench.limit(0)).count() == len(docs)
    assert benchmark_matches(df, bench.limit(0)).collect() == [] and benchmark_matches(df.limit(0), bench).collect() == []


def test_alignment_stays_in_its_band():
    """The distance within a band of diagonals, against the full table with all other cells barred."""
    rng = random.Random(5)
    for _ in range(300):
        item, text = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(2))
        width = rng.randrange(1, 6)
        table = [[0 if d < width else 99 for d in range(len(text) + width + 20)]]
        for r, c in enumerate(item, 1):
            row = []
            for d in range(width):
                same = r + d - 1 < len(text) and text[r + d - 1] == c
                row.append(min(table[-1][d] + (not same), table[-1][d + 1] + 1 if d + 1 < width else 99, row[d - 1] + 1 if d else 99))
            table.append(row + [99] * 20)
        best = min(table[-1][:width])
        (got,) = banded_alignments([points(item)], [points(text)], [width], np.array([3]))
        assert (got is None and best > 3) or got[0] == best


def test_item_of_a_hundred_thousand_characters():
    rng = random.Random(8)
    item = "".join(rng.choice("abcdefghij klmnop") for _ in range(100_000)).strip()
    cut = list(normal(item))
    for at in (10, 40_000, 70_000):
        cut[at] = "#"
    del cut[55_555]
    index = ItemIndex([(1, item)], 0.0005)
    found = index.search([points("before it " + "".join(cut) + " behind it"), points("x" * 100_000)])
    assert [(f[0], f[1], f[2]) for f in found] == [(0, 0, 4)]
    # what is held of a pair is its item, its text and its band, never their product
    assert list(_batches([points(item)] * 4, [302] * 4)) == [(0, 4)] and list(_batches([points(item)] * 9, [302] * 9))[0] == (0, 5)
