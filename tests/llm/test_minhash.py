import hashlib
import random

import numpy as np
import pyarrow as pa

from kinweave.llm.minhash import edited, fingerprint_documents, minhash_classes, prints, shingles, signatures
from plain import jaccard
from plain import shingle_set


def likeness(a, b):
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


def test_slots_estimate_the_similarity():
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    errors = []
    for cut in (30, 100, 300, 500):
        other = words[:cut] + [f"o{i}" for i in range(600 - cut)]
        a, b = prints(signatures(pa.array([" ".join(words), " ".join(other)])))
        errors.append((a == b).mean() - jaccard(shingle_set(" ".join(words), 5), shingle_set(" ".join(other), 5)))
    assert max(map(abs, errors)) < 0.2


def test_long_text_by_pieces_equals_whole():
    text = " ".join(str(i * 7919 % 100_003) for i in range(150_000))
    hashes, count = shingles(pa.array(["a b", text, "c"]))
    assert count.tolist() == [1, 149_996, 1]
    minima = signatures(pa.array(["a b", text, "c"]))
    from kinweave.llm.minhash import _A, _B

    with np.errstate(over="ignore"):
        assert minima[1, 5] == (hashes[1:-1] * _A[5] + _B[5]).min()
        assert minima[2, 9] == hashes[-1] * _A[9] + _B[9]


def check(spark, docs):
    got = {r["doc_id"]: r for r in fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string, n_chars string")).collect()}
    order = sorted(docs, key=lambda d: -d[0])
    for i, (k, t, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        r = got[k]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited(t, after).encode()).hexdigest()
        assert r["near_next"] == likeness(r["fingerprint"], got[order[(i + 1) % len(order)][0]]["fingerprint"])
        assert r["near_edited"] == likeness(r["fingerprint"], r["edited_fingerprint"])
    by_text = {}
    for k, t, _ in docs:
        assert by_text.setdefault(t or "", got[k]["fingerprint"]) == got[k]["fingerprint"]


def test_chain_of_documents(spark):
    rng = random.Random(3)
    docs = [(i * 3, " ".join(rng.choice("abcdeé𝄞") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), "x") for i in range(300)]
    check(spark, docs + [(1, None, "x"), (2, "", "x"), (4, "𝄞é", "x")])


def test_one_document_and_none(spark):
    check(spark, [(7, "a b c d e f", "x")])
    assert fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = fingerprint_documents(spark.createDataFrame([(None, "a"), (3, "b"), (3, "b")], "doc_id long, text string")).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["3", "3", "None"]


def test_repeated_and_null_keys_are_dealt_over_places(spark):
    from kinweave.llm.minhash import _in_chains

    docs = [(i, f"own {i}") for i in range(100)] + [(40, f"copy of key {i}") for i in range(300)] + [(None, f"no key {i}") for i in range(300)] + [(40, "same")] * 3
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = [r for r in _in_chains(table, "doc_id", "text").collect() if not r["ghost"]]
    for k in (40, None):
        assert len({r["place"] for r in rows if r["key"] == k}) > 3
    h = dict(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("text", "xxhash64(text)").distinct().collect())
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), h[d[1]], d[1]))
    expected = sorted((str(k), hashlib.sha256(edited(t, order[(i + 1) % len(order)][1]).encode()).hexdigest()) for i, (k, t) in enumerate(order))
    got = fingerprint_documents(table).collect()
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == expected


def test_classes_against_brute_force(spark):
    rng = random.Random(6)
    docs = []
    for i in range(30):
        words = [f"{i}x{rng.randrange(1000)}" for _ in range(80)]
        docs.append((i, " ".join(words)))
        for j in range(rng.randrange(3)):
            words[rng.randrange(80)] = "new"
            docs.append((100 + 10 * i + j, " ".join(words)))
    docs += [(900, docs[0][1]), (901, None), (902, "")]
    sets = {k: shingle_set(t, 5) for k, t in docs}
    parent = {k: k for k, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(docs):
        for b, _ in docs[:i]:
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r["doc_id"]: r["class_id"] for r in minhash_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: find(k) for k in parent}
