"""Pairs are neither written nor shuffled: what goes to disk grows with the records."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinweave.functions.similarity import jaro_winkler, jaro_winkler_of, jaro_winkler_udf, names_agree, names_agree_of
from kinweave.operators import blocking as B, pairs as P
from kinweave.plans.fixture import person

FOLDER = "/root/testdata/sf0.001"
CANDIDATES = ["op_j08_labels", "op_j01_attach", "op_p02_equal_differ", "op_j14_flags", "op_a24_stage_metrics", "op_a39_tiers_by_source", "op_a43_segments", "op_a47_tier_labels", "op_a19_class_report"]
BLOCKS = ["op_b13_batch_blocking", "op_b32_block_stats", "op_a03_pairs_per_block", "op_a12_false_negatives", "op_n03_marginal", "op_n04_block_overlap"]


@pytest.mark.parametrize("name", CANDIDATES + BLOCKS)
def test_no_shuffle_of_pairs(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert "hashpartitioning(id_a" not in plan and "kinweave-candidates" not in plan


def rows(df, *columns):
    return sorted(map(tuple, df.select("id_a", "id_b", "blocks", "n_blocks", *columns).collect()))


@pytest.mark.parametrize("cap, policy", [(500, "cap"), (5, "cap"), (5, "skip")])
def test_classes_give_what_the_plain_join_gives(spark, cap, policy):
    p = person(spark, FOLDER)
    plain = P.attach(B.pairs_within_keys(B.cap_keys(B.postings(p), cap, policy)), p, ["entity"])
    assert rows(B.candidate_pairs(p, B.BLOCKS, cap, policy, carry=("entity",)), "entity_l", "entity_r") == rows(plain, "entity_l", "entity_r")


@pytest.mark.parametrize("limit", [2, B.NO_LIMIT])
def test_carried_columns_and_limits(spark, limit):
    df = spark.createDataFrame([("a", "1", "x", 1), ("b", "1", "x", 2), ("c", "2", "x", None), ("d", "2", "", 4), ("e", None, "", 5)], "rec_id string, g string, e string, v int")
    found = {(a, b): (k, l, r) for a, b, k, n, l, r in rows(B.group_pairs(df, {"g": F.col("g"), "e": F.col("e")}, limit, carry=("v",)), "v_l", "v_r")}
    pairs = {("a", "b"): (["g"], 1, 2), ("c", "d"): (["g"], None, 4)}
    whole = {("a", "b"): (["e", "g"], 1, 2), ("a", "c"): (["e"], 1, None), ("b", "c"): (["e"], 2, None), ("c", "d"): (["g"], None, 4)}
    assert found == (pairs if limit == 2 else whole)


def test_repeated_ids_give_each_pair_once(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")], "rec_id string, g string")
    assert rows(B.group_pairs(df, {"g": F.col("g")}, B.NO_LIMIT)) == [("a", "b", ["g"], 1)]


def test_jaro_winkler_as_an_expression(spark):
    words = [None, "", "A", "MARTHA", "MARHTA", "DIXON", "DICKSONX", "JELLYFISH", "SMELLYFISH", "OTHER", "ELMSLEY", "ÉLÈVE", "ELEVÉ"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    assert all(r.s == jaro_winkler(r.a, r.b) for r in df.select("a", "b", jaro_winkler_of(F.col("a"), F.col("b")).alias("s")).collect())
    a, b = F.col("a"), F.col("b")
    assert df.withColumn("jw", jaro_winkler_udf("a", "b")).where(names_agree(a, b, F.col("jw")) != names_agree_of(a, b)).count() == 0


@pytest.mark.parametrize("cap, policy", [(500, "cap"), (5, "cap"), (5, "skip")])
def test_counts_are_those_of_the_pairs(spark, cap, policy):
    p = person(spark, FOLDER)
    plain = B.pairs_within_keys(B.cap_keys(B.postings(p), cap, policy)).groupBy("blocks").count()
    counted = B.candidate_counts(p, B.BLOCKS, cap, policy)
    assert sorted((r["blocks"], r["pairs"]) for r in counted.collect()) == sorted((r["blocks"], r["count"]) for r in plain.collect())


@pytest.mark.parametrize("phones", [2, 5])
def test_counts_of_records_with_many_phones(spark, phones):
    df = person(spark, FOLDER).where("entity < 40").withColumn("phones", F.transform(F.sequence(F.lit(1), F.lit(phones)), lambda i: F.concat(F.lit("p"), ((F.col("entity") + i * i) % 23).cast("string"))))
    plain = B.pairs_within_keys(B.cap_keys(B.postings(df))).groupBy("blocks").count()
    assert sorted((r["blocks"], r["pairs"]) for r in B.candidate_counts(df).collect()) == sorted((r["blocks"], r["count"]) for r in plain.collect())


@pytest.mark.parametrize("name", ["op_b32_block_stats", "op_a03_pairs_per_block", "op_n03_marginal", "op_n04_block_overlap"])
def test_counting_makes_no_pairs(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert "explode(ids" not in plan and "kinweave-classes" in plan


def test_features_come_along_with_the_pairs(spark):
    from kinweave.operators import linkage as L
    from kinweave.plans.rule_queries import candidates

    found = entry.queries()["op_m11_features"](spark, FOLDER)
    plan = found._jdf.queryExecution().toString()
    assert "hashpartitioning(id_a" not in plan and "kinweave-candidates" not in plan and "hashpartitioning(first_l" not in plan
    p, c = candidates(spark, FOLDER)
    whole = L.features(c, p)
    assert whole.columns == found.columns and sorted(map(str, whole.collect())) == sorted(map(str, found.collect()))


@pytest.mark.parametrize("name", ["op_m12_gate", "op_m13_matcher", "op_m14_contributions"])
def test_scoring_writes_and_shuffles_no_pairs(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().toString()
    assert "hashpartitioning(id_a" not in plan and "kinweave-features" not in plan and "kinweave-candidates" not in plan


def test_training_on_counted_rows(spark):
    """A row that comes n times weighs n: the model is that of the whole table, and contributions are ranked as by the window."""
    from pyspark.ml.classification import LogisticRegression

    from kinweave.operators import linkage as L
    from kinweave.plans.rule_queries import compared

    f = L.features_of(compared(spark, FOLDER, "entity").withColumn("label", F.col("entity_l") == F.col("entity_r")), "label").cache()
    r = f.agg(F.avg(F.col("label").cast("double"))).first()[0]
    data = L.vector(f).withColumn("_y", F.col("label").cast("double")).withColumn("_w", F.when(F.col("label"), 0.5 / r).otherwise(0.5 / (1 - r)))
    plain = LogisticRegression(featuresCol="x", labelCol="_y", weightCol="_w", regParam=0.01, maxIter=50).fit(data)
    model = L.train_matcher(f, kind="logistic")
    assert model.coefficients() == pytest.approx(plain.coefficients.toArray().tolist(), abs=1e-3)
    some = f.where(F.col("id_a") < "R00000100")
    text = lambda df: sorted((*r[:3], r["rank"], *(round(x, 9) for x in (r.contribution, r.running, r.probability))) for r in df.collect())
    old, new = L.waterfall(model.contributions(some), 0.5), L.waterfall_of(model.contributions(some, whole=True), 0.5)
    assert old.columns == new.columns and old.count() > 0 and text(old) == text(new)


@pytest.mark.parametrize("nodes", [3, 500_000])
def test_spanning_edges_keep_components_and_totals(spark, nodes):
    import random

    from kinweave.operators.components import connected_components, spanning_edges

    rng = random.Random(5)
    edges = [(f"n{min(e)}", f"n{max(e)}", 0.5) for g in range(20) for e in ((rng.randrange(g * 9, g * 9 + 9), rng.randrange(g * 9, g * 9 + 9)) for _ in range(40)) if e[0] != e[1]]
    df = spark.createDataFrame(edges, "a string, b string, v double").repartition(3)
    found = spanning_edges(df, "a", "b", ("v",), nodes).cache()
    thin = found.where("a is not null")
    parts = lambda e: sorted(map(tuple, connected_components(e, "a", "b").collect()))
    assert parts(thin) == parts(df) and (nodes == 3 or thin.count() <= 3 * 180 and thin.count() < len(edges))
    assert found.where("a is null").agg(F.sum("n"), F.sum("v")).first() == (len(edges), 0.5 * len(edges))


def test_match_stats_store_no_matches(spark, monkeypatch):
    from kinweave import storage

    made = []
    plain = storage.Stored.__init__
    monkeypatch.setattr(storage.Stored, "__init__", lambda self, df, tag="table": (made.append(tag), plain(self, df, tag))[1])
    assert entry.queries()["op_a05_match_stats"](spark, FOLDER).first()["pairs"] > 0
    assert "spanning" in made and not {"candidates", "matches"} & set(made)


def shuffled(df):
    """Bytes that running ``df`` shuffles."""
    store = df.sparkSession.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size())))
    stages = store.stageList(None, False, False, df.sparkSession.sparkContext._gateway.new_array(df.sparkSession.sparkContext._jvm.double, 0), None)
    before = written()
    df.write.format("noop").mode("overwrite").save()
    stages = store.stageList(None, False, False, df.sparkSession.sparkContext._gateway.new_array(df.sparkSession.sparkContext._jvm.double, 0), None)
    return written() - before


def keyed(spark, n):
    """Records of ten a date; every id is of one date, but that of every 50th record."""
    return spark.range(n).select(F.format_string("r%07d", "id").alias("rec_id"), F.when(F.col("id") % 31 != 0, (F.col("id") / 10).cast("int") + (F.col("id") % 50 == 0).cast("int")).cast("string").alias("d"), F.sha2((F.col("id") / 5).cast("int").cast("string"), 256).alias("g"))


def test_groups_without_new_pairs_are_not_shuffled(spark):
    df = keyed(spark, 20_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, both = (shuffled(B.group_pairs(df, {k: F.col(k) for k in names}, B.NO_LIMIT, blocks=False)) for names in ("d", "dg"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < one < both < 2.5 * one  # every g again, with its d, would be far more


@pytest.mark.parametrize("most", [0, B.NO_LIMIT])
def test_pairs_of_later_keys_are_whole(spark, monkeypatch, most):
    monkeypatch.setattr(B, "MOST_VARIED", most)
    df = keyed(spark, 300)
    keys = {k: F.col(k) for k in "dg"}
    plain = B.pairs_within_keys(df.select(F.lit("d").alias("block"), F.col("d").alias("key"), F.col("rec_id").alias("id")).unionByName(df.select(F.lit("g").alias("block"), F.col("g").alias("key"), F.col("rec_id").alias("id"))).where("key is not null"))
    assert rows(B.group_pairs(df, keys, B.NO_LIMIT)) == rows(plain)
    bare = B.group_pairs(df, keys, B.NO_LIMIT, blocks=False, carry=("d",))
    assert bare.columns == ["id_a", "id_b", "d_l", "d_r"]
    assert sorted(map(tuple, bare.select("id_a", "id_b").collect())) == [r[:2] for r in rows(plain)]


def test_codes_join_no_records(spark):
    from kinweave.functions.phonetic import double_metaphone, double_metaphone_udf, metaphone, metaphone_udf, with_code

    df = spark.createDataFrame([(x,) for x in ("SMITH", None, "", "SMITH", "THOMPSON")], "last string")
    for coder, plain in ((metaphone_udf, metaphone), (double_metaphone_udf, double_metaphone)):
        found = with_code(df, "last", "code", coder)
        assert "Join" not in found._jdf.queryExecution().toString()
        assert [tuple(r) for r in found.collect()] == [(r.last, None if r.last is None else plain(r.last)) for r in df.collect()]


@pytest.mark.parametrize("most", [0, B.NO_LIMIT])
def test_stacked_pairs_are_united_without_a_shuffle(spark, monkeypatch, most):
    from kinweave.operators import qgram as Q

    monkeypatch.setattr(B, "MOST_VARIED", most)
    p = B.valid_records(person(spark, FOLDER)).where("entity < 60")
    near = Q.near_texts(p.select(F.col("rec_id").alias("id"), Q.name_text().alias("t")))
    found = B.stacked_pairs(p, near, Q.name_text(), cap=5)
    plain = B.union_pairs(B.candidate_pairs(p, cap=5), Q.qgram_pairs(p))
    assert "hashpartitioning(id_a" not in found._jdf.queryExecution().toString()
    assert rows(found.withColumn("n_blocks", F.size("blocks"))) == rows(plain) and plain.where("blocks = array('QG')").count() > 0


def test_pruning_makes_pairs_once(spark):
    from kinweave.operators import graph as G

    rows = [(f"a{i % 7}", f"b{i}", ["B1"], 1.0 / (i % 5 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "id_a string, id_b string, blocks array<string>, weight double")
    kept = G.prune_top_k(df, 2)
    assert kept.columns == df.columns and "Join" not in kept._jdf.queryExecution().toString()
    best = lambda n: sorted((r for r in rows if n in r[:2]), key=lambda r: (r[3], r[0], r[1]))[-2:]
    want = {r[:2] for n in {x for r in rows for x in r[:2]} for r in best(n)}
    assert sorted((r.id_a, r.id_b) for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("name", ["op_g01_arcs", "op_g02_prune", "op_b16_stacked"])
def test_stacked_queries_join_no_pairs(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "_k0_l" not in plan and "near(" not in plan


def ranked(rows, k, weight):
    """The pairs among the k heaviest of either end, ties to the greater pair."""
    ends = {}
    for a, b, mask in rows:
        for node in (a, b):
            ends.setdefault(node, []).append((weight[mask], a, b, mask))
    return {x[1:] for found in ends.values() for x in sorted(found)[-k:]}


@pytest.mark.parametrize("k", [1, 3, 10])
def test_heaviest_of_either_end(spark, k):
    from kinweave.operators import qgram as Q

    p = B.valid_records(person(spark, FOLDER)).where("entity < 90").withColumn("dob", F.expr("case when entity % 3 = 0 then date'1970-01-01' else dob end"))
    near = Q.near_texts(p.select(F.col("rec_id").alias("id"), Q.name_text().alias("t")))
    s = B.Stacked(p, near, Q.name_text(), cap=5)
    rows = [tuple(r) for r in s.pairs().collect()]
    weight = [0.0, 0.5] + [0.01 * (m % 7) for m in range(2, 512)]
    found = [tuple(r) for r in s.best(s.counts(k), weight, 0.5, k).collect()]
    assert len(set(found)) == len(found) and set(found) == ranked(rows, k, weight) and 1 in {m for *_, m in found}


@pytest.mark.parametrize("rows, step, wide", [(7, 5, 1 << 24), (10_000, 64, 0), (50, 1 << 18, 300)])
def test_groups_and_blocks_of_pairs_of_any_size(spark, monkeypatch, rows, step, wide):
    from kinweave.operators import meeting as M, qgram as Q

    p = B.valid_records(person(spark, FOLDER)).where("entity < 60").withColumn("dob", F.expr("case when entity % 3 = 0 then date'1970-01-01' else dob end"))
    s = B.Stacked(p, Q.near_texts(p.select(F.col("rec_id").alias("id"), Q.name_text().alias("t"))), Q.name_text())
    table = s.post.repartition(1).sortWithinPartitions("_slot", "_key").toArrow()
    made = lambda run: sorted(tuple(r.values()) for b in run(iter(table.to_batches(max_chunksize=20))) for r in b.to_pylist())
    whole, best = made(M.stacked(*s.own)), made(M.lone_best(*s.own, 3))
    plain = M.triangles
    monkeypatch.setattr(M, "ROWS", rows)
    monkeypatch.setattr(M, "WIDE", wide)
    monkeypatch.setattr(M, "triangles", lambda end, down=False: plain(end, step, down))
    assert made(M.stacked(*s.own)) == whole and made(M.lone_best(*s.own, 3)) == best and best


def test_similarities_in_arrays():
    import random

    import numpy as np

    from kinweave.operators import compared as C

    rng = random.Random(3)
    words = sorted({"", "MARTHA", "MARHTA", "DIXON", "DICKSONX", "ÉLÈVE", "JELLYFISH", "SMELLYFISH", *("".join(rng.choice("AB1É") for _ in range(rng.randrange(1, 13))) for _ in range(150))})
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    assert C.jaro_winkler(C.Texts(words), a, b).tolist() == [jaro_winkler(words[x], words[y]) for x, y in zip(a, b)]

    def edits(s, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = [1.0 if not (s or t) else 1 - edits(s, t) / max(len(s), len(t)) for s, t in ((words[x], words[y]) for x, y in zip(a, b))]
    assert C.levenshtein_similarity(C.Texts(words), a, b).tolist() == want


@pytest.mark.parametrize("name", ["op_m11_features", "op_m12_gate"])
def test_features_join_no_records(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "_k0_l" not in plan
