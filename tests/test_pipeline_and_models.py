"""The batch run with and without models, the model registry, reports and review batches."""

import pytest
from pyspark.sql import functions as F

from kinweave import pipeline
from kinweave.functions.similarity import pair_bucket
from kinweave.operators import blocking as B, index as X, linkage as L, models as MO, pairs as P
from kinweave.plans.blocking_queries import true_pairs
from kinweave.plans.fixture import person
from kinweave.sources import files
from kinweave.storage import materialize

FOLDER = "/root/testdata/sf0.001"


def test_batch_run(spark, tmp_path):
    p = materialize(person(spark, FOLDER), "person")
    valid = B.valid_records(p)
    fs = L.estimate(true_pairs(valid), valid)
    plain = pipeline.link(p, pipeline.Options(fellegi_sunter=fs))
    verdicts = {r["stage"]: r["n"] for r in pipeline.stage_counts(plain).collect()}
    assert verdicts["candidates"] == sum(n for k, n in verdicts.items() if k != "candidates") and verdicts["auto_merge_rule"] > 0
    # without a gate model Fellegi-Sunter is the gate
    open_ = plain["decisions"].where("decision = 'human_review'").count()
    assert plain["pool"].count() == open_ - verdicts.get("gate_dropped", 0)
    assert plain["clusters"].count() == valid.count()

    labelled = P.attach(L.features(plain["candidates"], valid), valid, ["entity"]).withColumn("label", F.col("entity_l") == F.col("entity_r")).drop("entity_l", "entity_r")
    model = L.train_matcher(labelled.where(pair_bucket(F.col("id_a"), F.col("id_b"), "train") < 0.6), kind="logistic")
    manifest = pipeline.run_batch(p, f"file://{tmp_path}/runs", "run1", pipeline.Options(gate=model, matcher=model, matcher_feeds_clusters=True))
    assert {"candidates", "matches", "decisions", "gate", "pool", "matcher", "outcome", "clusters"} <= set(manifest["artifacts"])
    assert manifest["artifacts"]["outcome"]["rows"] == manifest["artifacts"]["candidates"]["rows"] == verdicts["candidates"]
    assert manifest["artifacts"]["matcher"]["rows"] == manifest["artifacts"]["pool"]["rows"]
    assert files.newest_run_with(spark, f"file://{tmp_path}/runs", "matcher") == "run1"


def test_model_registry(spark, tmp_path):
    folder = f"file://{tmp_path}/models"
    assert MO.active_model(spark, folder) is None
    MO.write_card(spark, folder, "a", 0.90, 0.90)
    assert MO.active_model(spark, folder) == "a" and MO.pointed(spark, folder) is None
    assert MO.promote(spark, folder, "a") and MO.pointed(spark, folder) == "a"
    MO.write_card(spark, folder, "b", 0.95, 0.85)
    with pytest.raises(MO.DeployRefused):
        MO.promote(spark, folder, "b")
    assert MO.active_model(spark, folder) == "a" and MO.active_model(spark, folder, "b") == "b" and MO.active_model(spark, folder, "x") is None
    assert MO.promote(spark, folder, "b", margin=0.05) and MO.active_model(spark, folder) == "b"
    assert not MO.promote(spark, folder, "c", force=True)  # no card, no such model: the pointer is passed over
    assert MO.pointed(spark, folder) is None and MO.active_model(spark, folder) == "b"
    calls = []
    for _ in range(2):
        MO.load_cached(spark, f"{folder}/b{MO.CARD}", lambda path: calls.append(path))
    assert len(calls) == 1
    assert MO.save_thresholds(spark, folder, gate=0.2) == {"gate": 0.2}
    assert MO.thresholds(spark, folder, gate=0.3, merge=0.7) == {"gate": 0.2, "merge": 0.7}
    with pytest.raises(ValueError):
        MO.save_thresholds(spark, folder, gate=2.0)


def test_reports_and_batches(spark, tmp_path):
    folder = f"file://{tmp_path}/reports"
    for name, f1 in (("r1", 0.5), ("r2", 0.75)):
        files.write_report(spark, folder, name, {"rules": {"f1": f1, "name": "x"}, "pairs": 7})
    got = files.read_reports(spark, folder)
    assert sorted((r["report"], r["metric"], r["value"]) for r in got.collect()) == [("r1.json", "pairs", 7.0), ("r1.json", "rules.f1", 0.5), ("r2.json", "pairs", 7.0), ("r2.json", "rules.f1", 0.75)]
    assert [(r["value"], r["change"]) for r in files.report_trend(got, "rules.f1").orderBy("report").collect()] == [(0.5, None), (0.75, 0.25)]
    rows = spark.createDataFrame([("a", "b", "missed"), ("a", "c", "missed"), ("d", "e", "wrong")], "id_a string, id_b string, batch string")
    files.write_review_batches(rows, f"file://{tmp_path}/review")
    assert (tmp_path / "review-index.csv").read_text() == "batch,rows\nmissed,2\nwrong,1\n"
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/review").count() == 3


def test_comparison_registry():
    r = L.REGISTRY.add(L.Comparison("sex"))
    assert r.fields[-1] == "sex" and "sex" not in L.REGISTRY.fields and r.remove("sex").fields == L.REGISTRY.fields
    assert r.replace(L.Comparison("sex", term_frequency=True)).items[-1].term_frequency
    with pytest.raises(ValueError):
        r.add(L.Comparison("sex"))


def test_index_store_commits_all_tables_or_none(spark, tmp_path):
    store = X.IndexStore(spark, f"file://{tmp_path}/index")
    assert store.read("postings").count() == 0 and not store.rollback()
    one = spark.createDataFrame([("B1", "k", "r1")], X.TABLES["postings"])
    members = spark.createDataFrame([("M-1", "r1", True)], X.TABLES["members"])
    store.commit(postings=one, members=members)
    store.commit(postings=one.unionByName(one.withColumn("id", F.lit("r2"))))
    assert store.read("postings").count() == 2 and store.read("members").count() == 1
    with pytest.raises(Exception):
        store.commit(postings=one.limit(0), members=one)  # the second table lacks its columns
    assert store.read("postings").count() == 2
    assert store.clean() == 1 and store.read("postings").count() == 2
    assert store.rollback() and store.read("postings").count() == 1 and store.read("members").count() == 1
    assert not store.rollback() and store.clean() == 1
