import random
import re

import xxhash

from kinweave.llm.near_copies import drop_near_copies, near_copy_classes
from kinweave.llm.simhash import simhash, simhash_components
from kinweave.llm.verify import SMALL_GROUP
from plain import jaccard
from plain import shingle_set
from kinweave.llm.verify import shingle_sets
from kinweave.llm.verify import verified_links


def plain(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def closure(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def texts(rng, n):
    words = [f"w{i}" for i in range(40)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 120))))
    return out


def test_fingerprint():
    for t in ["", None, "One", "one two", "A b\tC\nd e", "é É x\x0by z w", "a\xa0b c d", "x " * 300]:
        assert simhash(t) == plain(t), t


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    docs = list(enumerate(texts(rng, 150))) + [(200, ""), (201, None), (202, " \n"), (203, "Only One"), (204, "only one")]
    prints = {k: plain(t) for k, t in docs}
    want = closure([k for k, _ in docs], lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = simhash_components(spark.createDataFrame([(k, t, "f") for k, t in docs], "doc_id long, text string, fingerprint string")).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {k: (f"{prints[k]:016x}", want[k]) for k, _ in docs}


def test_components_edges(spark):
    got = simhash_components(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "q r s t u")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == [("4", 4), ("4", 4), ("9", 9), ("None", 4)]
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_groups_lose_no_link(spark):
    """One group of many copies around two originals, and strangers: components as of all pairs."""
    rng = random.Random(4)
    base = [[f"{p}{i}" for i in range(60)] for p in "ab"]
    made = []
    for b in base:
        made.append(" ".join(b))
        for _ in range(2 * SMALL_GROUP):
            w = list(b)
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(60)] = f"n{rng.randrange(10_000)}"
            made.append(" ".join(w))
    made += [" ".join(f"s{j}{i}" for i in range(60)) for j in range(2 * SMALL_GROUP)]
    named = [(f"{i:04d}", t) for i, t in enumerate(made)]
    rng.shuffle(named)
    named = [(f"{i:04d}", t) for i, (_, t) in enumerate(named)]
    sets = {k: shingle_set(t, 5) for k, t in named}
    want = closure([k for k, _ in named], lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    frame = spark.createDataFrame(named, "id string, text string")
    links = verified_links(frame.selectExpr("'g' as g", "id"), shingle_sets(frame)).collect()
    pairs = {(r["a"], r["b"]) for r in links}
    got = closure([k for k, _ in named], lambda a, b: (min(a, b), max(a, b)) in pairs)
    assert got == want


def test_large_groups_copies_of_copies(spark):
    """A text near a copy but not near the centre, and copies of such copies: components as of all pairs."""
    rng = random.Random(6)
    fresh = iter(range(100_000, 200_000))

    def changed(s, n):
        return frozenset(rng.sample(sorted(s), len(s) - n)) | {next(fresh) for _ in range(n)}

    h = frozenset(range(100))
    near = changed(h, 10)  # 90 of 110
    far = (near - set(rng.sample(sorted(near & h), 10))) | {next(fresh) for _ in range(10)}  # 90 of 110, and 80 of 120 with h
    chain = [h]
    for _ in range(8):
        chain.append(changed(rng.choice(chain[-3:]), 10))
    blank = [frozenset()] * 3
    made = {"first": [h, near, far] + [changed(h, 3) for _ in range(SMALL_GROUP)], "chain": chain + [changed(rng.choice(chain), 4) for _ in range(3 * SMALL_GROUP)] + blank}
    for group, sets in made.items():
        named = {f"{group}{i:03d}": s for i, s in enumerate(sets)}
        named = {("z" if s == h else "") + k: s for k, s in named.items()}
        want = closure(sorted(named), lambda a, b: len(named[a] & named[b]) >= 0.8 * len(named[a] | named[b]))
        frame = spark.createDataFrame([(k, sorted(s)) for k, s in named.items()], "id string, s array<int>")
        pairs = {(r["a"], r["b"]) for r in verified_links(frame.selectExpr("'g' as g", "id"), frame).collect()}
        assert closure(sorted(named), lambda a, b: (min(a, b), max(a, b)) in pairs) == want, group


def test_drop_near_copies(spark):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(150)) for _ in range(20)]
    docs = list(enumerate(base))
    for i, t in enumerate(base[:10]):
        w = t.split()
        w[70] = "changed"
        docs += [(100 + i, " ".join(w)), (200 + i, t)]
    docs += [(300, ""), (301, None), (5, base[5]), (None, base[6])]
    kept = drop_near_copies(spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, __kw_id int").drop("__kw_id")).collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(20), 300]
    assert drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_block_edits_are_found(spark):
    """Appended, inserted and replaced blocks at a similarity just above 0.8, short and long: recall against brute force."""
    rng = random.Random(12)
    vocabulary, weights = [f"w{i}" for i in range(20_000)], [1 / (i + 3) for i in range(20_000)]

    def prose(n):
        return rng.choices(vocabulary, weights, k=n)

    pairs = []
    for size in [60, 100, 200, 1000, 4000] * 24:
        w = prose(size)
        at = size // 3
        more, less = prose(int(size * 0.18)), prose(int(size * 0.06))
        for other in (w + more, w[:at] + more[: len(more) * 4 // 5] + w[at:], w[:at] + less + w[at + len(less) :]):
            a, b = " ".join(w), " ".join(other)
            if jaccard(shingle_set(a, 5), shingle_set(b, 5)) >= 0.8:
                pairs.append((a, b))
    assert len(pairs) >= 300
    docs = spark.createDataFrame(list(enumerate(sorted({t for p in pairs for t in p}))), "doc_id long, text string")
    roots = {r["id"]: r["root"] for r in near_copy_classes(docs).collect()}
    names = {r["text"]: r["id"] for r in docs.selectExpr("text", "concat(lpad(hex(xxhash64(text)), 16, '0'), lpad(hex(xxhash64('kw', text)), 16, '0')) as id").collect()}
    missed = [(len(a.split()), len(b.split())) for a, b in pairs if names[a] not in roots or roots[names[a]] != roots.get(names[b])]
    assert not missed, (len(missed), len(pairs))
