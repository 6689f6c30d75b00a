import math
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from kinweave.llm import mixing
from kinweave.llm.mixing import Shares, Target, bisect, mix_sources, mixed_documents, solve_exponent

SIZES = {"big": 400, "mid": 80, "small": 20, None: 10}


def docs(spark):
    rows, k = [], 0
    for s, n in SIZES.items():
        for _ in range(n):
            rows.append((k, "w " * (1 + k % 5), s, "x"))
            k += 1
    rows += [(k, None, "big", "x"), (k + 1, "", "mid", "x"), (None, "a b", "small", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, block string"), rows


def test_bisect():
    assert abs(bisect(lambda a: 3 - a, 2.5) - 0.5) < 1e-12
    assert bisect(lambda a: 3 - a, 9) == 0 and bisect(lambda a: 3 - a, 1) == 1


@pytest.mark.parametrize("collect", [100_000, 0])
def test_targets(spark, monkeypatch, collect):
    monkeypatch.setattr(mixing, "COLLECT_SOURCES", collect)
    shares = Shares(spark.createDataFrame([("a", 900), ("b", 90), ("c", 10), ("d", 0)], "source string, tokens long"))
    p = [0.9, 0.09, 0.01]
    a = solve_exponent(shares, Target(entropy=0.8))
    q = [x**a for x in p]
    assert abs(-sum(x / sum(q) * math.log(x / sum(q)) for x in q) - 0.8) < 1e-6
    a = solve_exponent(shares, Target(repeats=3.0))
    assert abs((p[0] / p[2]) ** (1 - a) - 3.0) < 1e-6
    assert solve_exponent(shares, Target(entropy=5.0)) == 0 and solve_exponent(shares, Target(entropy=0.01)) == 1
    with pytest.raises(ValueError):
        Target()


def test_mix_covers_repeats_and_balances(spark):
    df, rows = docs(spark)
    got = mix_sources(df, Target(repeats=3.0), block_tokens=200).collect()
    times = Counter((r["doc_id"], r["source"]) for r in got)
    assert set(times) == {(k, s) for k, _, s, _ in rows}
    assert max(times.values()) <= 3 and all(times[k, "big"] == 1 for k, t, s, _ in rows if s == "big")
    assert max(r["epoch"] for r in got if r["source"] is None) == 2
    places = [(r["block"], r["position"]) for r in got]
    assert len(set(places)) == len(places)
    share = defaultdict(Counter)
    for r in got:
        share[r["block"]][r["source"]] += r["tokens"]
    total = Counter()
    for c in share.values():
        total.update(c)
    for c in list(share.values())[1:-1]:
        assert abs(c["big"] / sum(c.values()) - total["big"] / sum(total.values())) < 0.15
    # the last epoch is cut at the budget: no source gets more than its budget plus a document
    assert total[None] <= 3 * sum(len(t.split()) for _, t, s, _ in rows if s is None)


def test_budget_and_repeated_rows(spark):
    df, rows = docs(spark)
    some = mix_sources(df, Target(repeats=9.0), total=300.0).collect()
    assert sum(r["tokens"] for r in some) < 300 + 5 * 4
    twice = df.unionByName(df.where("doc_id = 0"))
    got = [r for r in mix_sources(twice, Target(repeats=2.0)).collect() if r["doc_id"] == 0]
    assert len(got) == 2 and len({(r["block"], r["position"]) for r in got}) == 2


def test_documents(spark):
    df, rows = docs(spark)
    df = df.withColumnRenamed("block", "u1").withColumn("__kw_first0", F.lit(1)).withColumn("__KW_times0", F.lit(2))
    out = mixed_documents(df, Target(repeats=2.0))
    assert out.columns == df.columns
    assert {r["doc_id"] for r in out.collect()} == {k for k, *_ in rows}
    assert mixed_documents(df.limit(0), Target(repeats=2.0)).collect() == []
    assert mix_sources(df.limit(0), Target(entropy=1.0)).collect() == []


def spark_hash(*values):
    """xxhash64 of Spark: ("q", long), ("i", int) or text; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<" + v[0], v[1]), h)
    return h - (1 << 64) if h >> 63 else h


def plain_mix(rows, most, block_tokens):
    """[(key, source, epoch, block, position)] by plain loops, with the same hashes."""
    units, sources = [], defaultdict(list)
    for k, t, s, _ in rows:
        key = None if k is None else ("q", k)
        k1, k2 = ("q", spark_hash(t)), ("q", spark_hash("kw", t))
        units.append((spark_hash(key, k1), spark_hash("unit", key, s, k2), k, s, len((t or "").split())))
        sources[s].append(units[-1])
    tokens = {s: sum(u[4] for u in us) for s, us in sources.items()}
    p = {s: n / sum(tokens.values()) for s, n in tokens.items() if n}

    def budgets(a):
        z = sum(x**a for x in p.values())
        total = max(tokens.values()) * z / max(p.values()) ** a
        return total, {s: total * x**a / z for s, x in p.items()}

    a = bisect(lambda x: max(budgets(x)[1][s] / tokens[s] for s in p), most)
    total, own = budgets(a)
    blocks = max(1, math.ceil((total + sum(u[4] == 0 for u in units)) / block_tokens))
    placed = []
    for s, us in sources.items():
        budget = math.ceil(own[s] - 1e-6) if s in own else 0
        start = 0
        for epoch in range(max(1, math.ceil(budget / tokens[s]) if tokens[s] else 1)):
            for order, u1, u2, k, n in sorted((spark_hash(("q", u1), ("q", u2), ("i", epoch), ("i", 0)), u1, u2, k, n) for u1, u2, k, _, n in us):
                if (n and start < budget) or (not n and epoch == 0):
                    share = min(1.0, start / max(budget, 1)) if n else order / 2.0**64 + 0.5
                    block = min(math.floor(share * blocks), blocks - 1)
                    placed.append((block, spark_hash(("q", order), ("i", block)), u1, u2, epoch, k, s))
                start += n
    out, seen = [], Counter()
    for block, _, _, _, epoch, k, s in sorted(placed, key=lambda x: x[:5]):
        out.append((k, s, epoch, block, seen[block]))
        seen[block] += 1
    return out


def test_every_emission_against_a_plain_mixer(spark):
    df, rows = docs(spark)
    for most, block_tokens in ((3.0, 200), (1.5, 1000)):
        got = [(r["doc_id"], r["source"], r["epoch"], r["block"], r["position"]) for r in mix_sources(df, Target(repeats=most), block_tokens=block_tokens).collect()]
        assert sorted(got, key=str) == sorted(plain_mix(rows, most, block_tokens), key=str)


def test_blank_texts_are_spread(spark):
    rows = [(k, "" if k % 2 else "a b c d", "s" if k % 2 else "t", None) for k in range(2000)]
    got = Counter(r["block"] for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, x string"), Target(repeats=2.0), block_tokens=500).collect() if r["source"] == "s")
    assert len(got) == 10 and max(got.values()) < 200
