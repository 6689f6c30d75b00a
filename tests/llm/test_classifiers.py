import random
import zlib

import numpy as np
import pyarrow as pa

from kinweave.llm.quality import keep_quality, score_quality
from kinweave.llm.subword import PAD, Model, Settings, bag, held_out, labelled_sample, marked, split_words, train, word_features
from kinweave.llm.toxicity import score_toxicity

SMALL = Settings(buckets=1 << 14, max_train=800, epochs=8)


def corpus(rng, n):
    plain = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(words) // 10):
                words[rng.randrange(len(words))] = rng.choice(["idiotic", "scumbag", "worthless"])
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_features_do_not_depend_on_neighbours():
    words = [b"a", b"worthless", "größe".encode(), b"x" * 300]
    together, counts = word_features(words, SMALL)
    at = 0
    for w, c in zip(words, counts):
        alone, n = word_features([w], SMALL)
        assert n[0] == c and together[at : at + c].tolist() == alone.tolist()
        at += c


M64 = (1 << 64) - 1


def plain_features(word, s):
    """The buckets of a word by its definition: a hash of the whole word and of each character n-gram's bytes."""
    p0, p1, p2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD
    mixed = [(b * p0 & M64) ^ ((b * p0 & M64) >> 29) for b in b"<" + word.encode() + b">"]
    hashes = [(sum(m * pow(p1, i + 1, 1 << 64) for i, m in enumerate(mixed)) & M64) ^ p2]
    for n in s.ngrams:
        for i in range(len(mixed) - n + 1):
            h = 0
            for m in mixed[i : i + n]:
                h = h * p1 + m & M64
            hashes.append(h + n & M64)
    out = []
    for h in hashes:
        h = (h ^ h >> 33) * p2 & M64
        out.append((h ^ h >> 33) % s.buckets)
    return out


def plain_bag(text, s):
    """{bucket: share} of a text: the average over its words, and PAD as often as set, of the average over their features."""
    words = [w.decode() for w in marked(text.lower() if s.lower else text, s.repeats)] + [PAD] * s.pad
    share = {}
    for w in words:
        own = plain_features(w, s)
        for b in own:
            share[b] = share.get(b, 0) + 1 / len(own) / len(words)
    return share


def test_forward_pass_against_plain_python():
    for s in (Settings(buckets=512, ngrams=(2, 3), pad=3), Settings(buckets=512, ngrams=(3,), pad=2, lower=False, repeats=True)):
        weights = np.random.default_rng(1).normal(size=s.buckets)
        model = Model(s, weights, 0.25)
        texts = ["a b b B", "größe " * 9 + "x", "", "one", "one one", "y " * 3000]
        want = [sum(weights[b] * x for b, x in plain_bag(t, s).items()) + 0.25 for t in texts]
        assert np.allclose(model.logits(pa.array(texts)), want)


def test_training_against_plain_python():
    """One epoch over three texts, by loops over buckets and dimensions."""
    s = Settings(buckets=64, ngrams=(2,), pad=2, epochs=1, dim=3, lower=True)
    texts, y = ["bad worse", "fine day today", "bad day"], [1, 0, 1]
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32).tolist()
    out = [[0.0] * s.dim, rng.normal(0, 0.1, s.dim).tolist()]
    squares, out_sq, bias, bias_sq = [1e-4] * s.buckets, [[1e-4] * s.dim for _ in range(2)], [0.0, 0.0], [1e-4, 1e-4]
    weight = [3 / (2 * 1), 3 / (2 * 2)]
    for i in rng.permutation(3):
        bags = plain_bag(texts[i], s)
        hidden = [sum(x * vectors[b][d] for b, x in bags.items()) for d in range(s.dim)]
        z = [sum(o * h for o, h in zip(row, hidden)) + c for row, c in zip(out, bias)]
        e = [np.exp(v - max(z)) for v in z]
        p = [(v / sum(e) - (c == y[i])) * weight[y[i]] for c, v in enumerate(e)]
        back = [sum(p[c] * out[c][d] for c in range(2)) for d in range(s.dim)]
        for c in range(2):
            for d in range(s.dim):
                g = p[c] * hidden[d]
                out_sq[c][d] += g * g
                out[c][d] -= s.rate * g / out_sq[c][d] ** 0.5
            bias_sq[c] += p[c] ** 2
            bias[c] -= s.rate * 0.1 * p[c] / bias_sq[c] ** 0.5
        for b, x in bags.items():
            squares[b] += x * x * sum(v * v for v in back) / s.dim
            for d in range(s.dim):
                vectors[b][d] -= s.rate * x / squares[b] ** 0.5 * back[d]
    model = train(texts, y, s)
    want = [sum(v * (out[1][d] - out[0][d]) for d, v in enumerate(row)) for row in vectors]
    assert np.allclose(model.weights, want, atol=1e-4) and abs(model.bias - (bias[1] - bias[0])) < 1e-4


def test_words_and_marks():
    coded, first = split_words(pa.array([" A  b ", None, "", "c"]), lower=True)
    assert [coded.dictionary[i].as_py() for i in coded.indices.to_pylist()] == ["a", "b", "c"] and first.tolist() == [0, 2, 2, 2, 3]
    assert marked("a a b", True) == [b"a", b"a", b"\x01same", b"b"] and marked(None, True) == []
    assert bag("b a b") == ("b a", np.array([2, 1], np.int32).tobytes())


def test_repeated_keys_collect_one_bag(spark):
    docs = spark.createDataFrame([(1, "a b")] * 50 + [(1, "c"), (2, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    bags, y = labelled_sample(docs, labels, "toxic", 5, 4, SMALL)
    assert [b[0] for b in bags] == ["a b", "d"] and y == [1, 0]


def test_held_out_accuracy_and_unseen_spellings(spark):
    rows = corpus(random.Random(1), 1000)
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(None, None, "x"), (5000, "", "x"), (5001, "   ", "x"), (5002, "word " * 50_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (77_777, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(docs, labels, SMALL).collect()}
    assert len(got) == 1004
    for k, r in got.items():
        assert r["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    right = [got[k]["predicted"] == y for k, _, y in rows if got[k]["held_out"]]
    assert np.mean(right) > 0.93
    assert got[5000]["predicted"] == got[5001]["predicted"] == got[None]["predicted"] == 0
    model = train([t for _, t, _ in rows], [y for _, _, y in rows], SMALL)
    s = model.scores(pa.array(["bana lupo scumbagg mire " * 4, "bana lupo mire " * 5]))
    assert s[0] > 0.5 > s[1]


def test_labels_of_the_held_out_fold_are_never_used(spark):
    rows = corpus(random.Random(2), 300)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    flip = [(k, 1 - y if held_out(k, 5, 0) else y) for k, _, y in rows]
    a = score_toxicity(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"), SMALL)
    b = score_toxicity(docs, spark.createDataFrame(flip, "doc_id long, toxic int"), SMALL)
    assert sorted(a.collect()) == sorted(b.collect())


def test_quality_sees_repeats_and_symbols(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) + rng.choice(["", ".", ","]) for _ in range(40)) for _ in range(200)]
    bad = [" ".join(w for w in rng.choices(["alpha", "beta", "rho"], k=6) for _ in range(9)) for _ in range(60)] + ["### $$$ alpha%%% " * 9 for _ in range(40)]
    rows = [(i, t, 1) for i, t in enumerate(good)] + [(1000 + i, t, 0) for i, t in enumerate(bad)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    settings = Settings(lower=False, ngrams=(2, 3), repeats=True, buckets=1 << 14)
    got = {r["doc_id"]: r for r in score_quality(docs, labels, settings).collect()}
    assert np.mean([got[k]["predicted"] == y for k, _, y in rows if got[k]["held_out"]]) > 0.97
    kept = {r["doc_id"] for r in keep_quality(docs, labels, settings).collect()}
    assert kept == {k for k in got if got[k]["predicted"]}


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert score_toxicity(docs, none, SMALL).first()["score"] == 0.5
    assert score_quality(docs.limit(0), none, SMALL).collect() == []


def test_rare_words_of_long_labelled_texts_are_learnt(spark):
    """The one word that tells stands in no place that an even draw of 256 words reads."""
    rng = random.Random(4)
    plain = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    rows = []
    for i in range(200):
        words = [rng.choice(plain) for _ in range(3000)]
        drawn = set(np.linspace(0, 2999, 256).astype(int).tolist())
        if i % 2:
            for at in rng.sample([j for j in range(3000) if j not in drawn], 40):
                words[at] = "scumbag"
        rows.append((i, " ".join(words), i % 2))
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    bags, _ = labelled_sample(docs, labels, "toxic", 5, 0, SMALL)
    assert sum("scumbag" in words.split() for words, _ in bags) == sum(y for k, _, y in rows if not held_out(k, 5, 0))
    got = {r["doc_id"]: r for r in score_toxicity(docs, labels, SMALL).collect()}
    assert np.mean([got[k]["predicted"] == y for k, _, y in rows if got[k]["held_out"]]) > 0.9
