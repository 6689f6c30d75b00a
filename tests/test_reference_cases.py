"""Cases with the answers written down, for operators whose SQL alone would repeat the code."""

from datetime import date

from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.operators import metrics as M, rules as R


def test_signal(spark):
    cases = [
        ("reject", 0.99, 0.9, 0.9, "implausible", None, "none"),
        ("gate_dropped", 0.99, 0.9, 0.25, "unlikely", 0.25, "gate"),
        ("gate_dropped", None, 0.9, 0.1, "implausible", 0.1, "gate"),
        ("gate_dropped", None, None, None, "implausible", None, "none"),
        ("auto_merge_rule", 0.99, None, None, "confident", 0.99, "rule"),
        ("ml_auto_merge", None, 0.1, None, "confident", 0.1, "model"),
        ("ml_human_review", None, 0.95, None, "leans", 0.95, "model"),
        ("undecided", None, 0.4, None, "leans", 0.4, "model"),
        ("undecided", None, 0.39, None, "uncertain", 0.39, "model"),
        (None, None, 0.19, None, "ambiguous", 0.19, "model"),
        (None, None, None, 0.9, "ambiguous", None, "none"),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "verdict string, confidence double, ml double, gate double")
    got = df.select(S.signal(*[F.col(c) for c in df.columns]).alias("s")).select("s.*").collect()
    assert [(r["band"], r["score"], r["origin"]) for r in got] == [c[4:] for c in cases]


def test_display(spark):
    text = [("Ann ", "ANN", "exact"), ("Ann", "Anna", "different"), (None, "a", "missing"), ("", "a", "missing")]
    assert [r[0] for r in spark.createDataFrame([t[:2] for t in text], "a string, b string").select(S.display_status(F.col("a"), F.col("b"))).collect()] == [t[2] for t in text]
    sets = [(["1", "2"], ["2", "1", "1"], "exact"), (["1", "2"], ["2"], "partial"), (["1"], ["2"], "different"), ([" "], ["2"], "missing"), (None, ["2"], "missing")]
    assert [r[0] for r in spark.createDataFrame([t[:2] for t in sets], "a array<string>, b array<string>").select(S.display_sets(F.col("a"), F.col("b"))).collect()] == [t[2] for t in sets]


def test_adjudication(spark):
    day, other = date(1980, 2, 3), date(1971, 5, 6)
    base = dict(first="MARIA", last="OAKLEY", dob=day, gov_id=None, email=None, phones=[], addr=None, sex="F", postal=None)
    cases = [
        ({}, {}, "SAME"),
        ({}, dict(dob=other), "SAME"),  # strong names need no backing
        (dict(first="MARIANA"), dict(dob=other, last="OAKLY", gov_id="123456780"), "SAME"),  # containment 0.92, last name 0.9 and over
        (dict(first="HUGO"), {}, "UNCERTAIN"),
        (dict(first="HUGO"), dict(dob=other), "DIFFERENT"),
        (dict(first="HUGO", sex="M"), {}, "DIFFERENT"),
        (dict(first="HUGO", gov_id="111111111"), dict(gov_id="111111111"), "DIFFERENT"),  # a placeholder backs nothing
        (dict(first="MARINELLO", gov_id="111111111", dob=other), dict(gov_id="111111111"), "DIFFERENT"),
        (dict(first="MARINELLO", gov_id="482913650", dob=other), dict(gov_id="482913650"), "UNCERTAIN"),
    ]
    records, pairs = [], []
    for i, (a, b, _) in enumerate(cases):
        records += [{"rec_id": f"{i}a"} | base | a, {"rec_id": f"{i}b"} | base | b]
        pairs.append((f"{i}a", f"{i}b"))
    schema = "rec_id string, first string, last string, dob date, gov_id string, email string, phones array<string>, addr string, sex string, postal string"
    got = {r["id_a"]: (r["verdict"], r["reason"]) for r in R.adjudicate(spark.createDataFrame(pairs, "id_a string, id_b string"), spark.createDataFrame(records, schema)).collect()}
    assert [got[f"{i}a"][0] for i in range(len(cases))] == [c[2] for c in cases]
    assert got["7a"][1] == "placeholder_id"


def test_bootstrap_resamples_decided_pairs_only(spark):
    rows = [("r", "SAME")] * 90 + [("r", "DIFFERENT")] * 10 + [("r", "UNCERTAIN")] * 500 + [("none", "UNCERTAIN")] + [("sure", "SAME")] * 20 + [("big", "SAME")] * 2700 + [("big", "DIFFERENT")] * 300
    got = {r["match_rule"]: r for r in M.bootstrap_precision(spark.createDataFrame(rows, "match_rule string, verdict string")).collect()}
    assert got["r"]["decided"] == 100 and got["r"]["precision"] == 0.9
    assert 0.82 <= got["r"]["low"] <= 0.86 and 0.94 <= got["r"]["high"] <= 0.97  # a binomial of 100 at 0.9
    assert got["none"]["precision"] is None and got["none"]["low"] is None
    assert got["sure"]["low"] == got["sure"]["high"] == 1.0
    assert 0.885 <= got["big"]["low"] <= 0.892 and 0.908 <= got["big"]["high"] <= 0.915
