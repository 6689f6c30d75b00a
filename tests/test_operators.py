"""Invariants of the graph, rule, index and incremental operators."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking as B, graph as G, index as X, linkage as L, metrics as M, pairs as P, perturb, qgram as Q, rules as R
from kinweave.operators.components import connected_components
from kinweave.operators.ranking import global_rank
from kinweave.plans.fixture import person

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def people(spark):
    return person(spark, FOLDER).cache()


def closure(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "src long, dst long, node string")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == closure(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_global_rank(spark):
    got = global_rank(spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "v int"), ["v"], "r").collect()
    assert all(r["r"] == r["v"] + 1 for r in got) and len(got) == 101


def test_blocking(spark, people):
    pairs = B.candidate_pairs(people).cache()
    assert pairs.where("id_a >= id_b").isEmpty() and pairs.where("n_blocks <> size(blocks)").isEmpty()
    assert P.missing_ids(pairs, B.valid_records(people)).isEmpty()
    small, every = B.cap_keys(B.postings(people), 3), B.postings(people)
    assert small.groupBy("block", "key").count().where("count > 3").isEmpty() and small.count() < every.count()
    assert B.cap_keys(every, 10**9, "skip").count() == every.count()
    with pytest.raises(ValueError):
        B.cap_keys(every, 3, "drop")
    none = spark.createDataFrame([("x", None), ("y", False), ("z", True)], "rec_id string, is_valid boolean")
    assert {r[0] for r in B.valid_records(none).select("rec_id").collect()} == {"x", "z"}


def test_pruning_is_a_subset_and_keeps_ties_to_the_greater_pair(spark):
    w = spark.createDataFrame([("a", b, 1.0) for b in "bcdef"] + [("x", "y", 0.1)], "id_a string, id_b string, weight double")
    kept = {(r.id_a, r.id_b) for r in G.prune_top_k(w, 1).collect()}
    assert ("a", "f") in kept and ("x", "y") in kept and len(kept) == 6
    assert {(r.id_a, r.id_b) for r in G.prune_top_k(w.where("id_a = 'a'"), 1).collect()} == {("a", b) for b in "bcdef"}


def test_qgrams(spark):
    got = spark.range(1).select(Q.grams(F.lit("ab c"))).first()[0]
    assert sorted(got) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])


def test_decision_pools_are_disjoint_and_exhaustive(people):
    p = B.valid_records(people)
    c = B.candidate_pairs(p).select("id_a", "id_b").cache()
    m = R.apply_rules(c, p).cache()
    d = R.three_way(c, m, p)
    assert d.count() == c.count() == d.select("id_a", "id_b").distinct().count()
    assert d.where("decision = 'auto_merge'").count() == m.count()
    assert m.where("not array_contains(rules_fired, match_rule)").isEmpty()


def record(i, **k):
    return {"rec_id": i, "first": None, "last": None, "dob": None, "gov_id": None, "email": None, "phones": [], "addr": None, "sex": None, "postal": None, "is_valid": True} | k


SCHEMA = "rec_id string, first string, last string, dob date, gov_id string, email string, phones array<string>, addr string, sex string, postal string, is_valid boolean"


def test_rules_case_by_case(spark):
    day = date(1980, 3, 4)
    rows = [
        record("a1", gov_id="1", dob=day), record("a2", gov_id="1", dob=day), record("b1", first="ANN", last="GARCIA", dob=day, email="e"), record("b2", first="ANNE", last="GRACIA", dob=day, email="e"),
        record("c1", first="ANN", last="LEE", dob=day, phones=["1", "2"]), record("c2", first="ANN", last="LEE", dob=day, phones=["2"]), record("d1"), record("d2"), record("e1", first="ANN", last="LEE", dob=day), record("e2", first="BOB", last="RAY", dob=date(1990, 1, 1)),
    ]
    records = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    pairs = spark.createDataFrame([(f"{x}1", f"{x}2") for x in "abcde"], "id_a string, id_b string")
    m = R.apply_rules(pairs, records)
    assert {r["id_a"]: r["match_rule"] for r in m.collect()} == {"a1": "id_dob", "b1": "name_dob_email", "c1": "name_dob_phone"}
    assert {r["id_a"]: r["decision"] for r in R.three_way(pairs, m, records).collect()} == {"a1": "auto_merge", "b1": "auto_merge", "c1": "auto_merge", "d1": "human_review", "e1": "no_match"}


def test_fellegi_sunter(spark, people):
    p = B.valid_records(people)
    c = B.candidate_pairs(p).select("id_a", "id_b")
    truth = P.attach(c, p, ["entity"]).where("entity_l = entity_r").select("id_a", "id_b")
    fitted = L.estimate(truth, p)
    assert fitted.inversions() == [] and 0 < fitted.prior < 0.1
    scored = P.attach(L.score(c, p, fitted), p, ["entity"]).withColumn("label", F.col("entity_l") == F.col("entity_r")).withColumnRenamed("match_probability", "score")
    assert M.roc_auc(scored).first()["auc"] > 0.97
    em = L.expectation_maximisation(L.gamma_patterns(L.gammas(c, p)), fitted.u)
    assert all(0 < v < 1 for v in em.m.values())
    with pytest.raises(ValueError):
        L.REGISTRY.add(L.Comparison("first"))
    assert "first" not in L.REGISTRY.remove("first").fields


def test_matcher_and_contributions(spark, people):
    p = B.valid_records(people)
    c = B.candidate_pairs(p).select("id_a", "id_b")
    f = P.attach(L.features(c, p), p, ["entity"]).withColumn("label", F.col("entity_l") == F.col("entity_r")).cache()
    model = L.train_matcher(f, kind="logistic")
    scored = model.score(f)
    assert M.roc_auc(scored).first()["auc"] > 0.97
    total = model.contributions(f).groupBy("id_a", "id_b").agg(F.sum("contribution").alias("s"))
    off = scored.join(total, ["id_a", "id_b"]).select(F.max(F.abs(F.log(F.col("score") / (1 - F.col("score"))) - F.col("s") - model.model.intercept))).first()[0]
    assert off < 1e-5


def test_cluster_metrics_bounds(spark):
    t = spark.createDataFrame([(i, i // 3) for i in range(12)], "id int, cluster_id int")
    same = M.b_cubed(t, t).first()
    assert (same["precision"], same["recall"]) == (1.0, 1.0)
    alone = M.b_cubed(t, t.withColumn("cluster_id", F.col("id"))).first()
    assert alone["precision"] == 1.0 and alone["recall"] == pytest.approx(1 / 3)
    assert [r["status"] for r in M.cluster_recovery(t, t).collect()] == ["exact"]
    empty = spark.createDataFrame([], "label boolean, p boolean")
    r = M.binary_confusion(empty, F.col("label"), F.col("p")).first()
    assert (r["tp"], r["precision"], r["recall"]) == (0, None, None)


def test_reconcile_gives_an_old_id_to_one_cluster_only(spark):
    members = spark.createDataFrame([("M-1", "a"), ("M-1", "b"), ("M-2", "c"), ("M-9", "z")], "entity_id string, rec_id string")
    clusters = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 2), ("e", 3), ("z", 4), ("y", 4)], "id string, cluster_id long")
    got, suggested = X.reconcile(clusters, members, spark.createDataFrame([("z",)], "rec_id string"))
    owner = {r["rec_id"]: r["entity_id"] for r in got.collect()}
    assert owner["a"] == "M-1" and owner["c"] == owner["d"] == "M-2" and owner["z"] == "M-9" and "y" not in owner
    assert owner["b"] not in ("M-1", None) and len({owner["a"], owner["b"], owner["e"]}) == 3
    assert {r["rec_id"] for r in suggested.collect()} == {"y", "z"}


def test_incremental_equals_batch(spark, people):
    p = B.valid_records(people).cache()
    edges = R.apply_rules(B.candidate_pairs(p).select("id_a", "id_b"), p).select("id_a", "id_b")
    batch = {r["id"]: r["cluster_id"] for r in G.assign_clusters(p, edges).collect()}
    half = F.pmod(F.xxhash64("rec_id"), F.lit(2)) == 0
    first, second = p.where(half), p.where(~half)
    none = spark.createDataFrame([], "entity_id string, rec_id string")
    members, postings = X.score_batch(first, first.limit(0), none, spark.createDataFrame([], "block string, key string, id string"))
    members = spark.createDataFrame(members.collect(), members.schema)
    final, _ = X.score_batch(second, first, members, spark.createDataFrame(postings.collect(), postings.schema))
    groups = {}
    for r in final.collect():
        groups.setdefault(r["entity_id"], set()).add(r["rec_id"])
    wanted = {}
    for k, v in batch.items():
        wanted.setdefault(v, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_store_and_decisions(spark, tmp_path):
    store = X.IndexStore(spark, f"file://{tmp_path}")
    assert store.read("decisions").isEmpty()
    first = X.decide(store.read("decisions"), spark, ["b", "a", "c"], "same", 1, 1)
    store.commit(decisions=first)
    second = X.decide(store.read("decisions"), spark, ["a", "b"], "different", 2, 2)
    store.commit(decisions=second)
    assert {(r["id_a"], r["id_b"]): r["decision"] for r in store.read("decisions").collect()} == {("a", "b"): "different", ("a", "c"): "same", ("b", "c"): "same"}
    assert X.retract(store.read("decisions"), 1).count() == 1
    m = X.with_primary(spark.createDataFrame([("M-1", "a"), ("M-1", "b"), ("M-2", "c")], "entity_id string, rec_id string"))
    merged = X.merge_entities(m, "M-1", ["M-2"])
    assert merged.where("entity_id = 'M-1'").count() == 3 and merged.where("is_primary").count() == 1
    assert {r["entity_id"] for r in X.unmerge_records(merged, "M-1", ["c"], "M-3").collect()} == {"M-1", "M-3"}


def test_perturbations(people):
    names = tuple(n for n in perturb.perturbations() if n != "phones_reordered")
    changed = perturb.scenarios(B.valid_records(people), names)
    assert {r["scenario"] for r in changed.select("scenario").distinct().collect()} >= {"swap_last", "truncate_last", "swap_month_day", "january_first", "id_digit", "postal_changed"}
    recall = {r["scenario"]: r["recall"] for r in perturb.blocking_recall(B.valid_records(people)).collect()}
    assert recall["phones_reordered"] == 1.0 and min(v for v in recall.values() if v is not None) > 0.9


def test_merge_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "id_a string, id_b string")
    ids = spark.createDataFrame([(x,) for x in "abcde"], "rec_id string")
    paths = {(r["id_a"], r["id_b"]): r["path"] for r in G.merge_paths(G.assign_clusters(ids, edges), edges).collect()}
    assert len(paths) == 6 and len(paths["a", "d"]) == 4
