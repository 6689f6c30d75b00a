"""Evaluation: pair, cluster and stage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.operators.rules import AUTO, NO_MATCH, REVIEW

ROUTES = (AUTO, REVIEW, NO_MATCH)


def n_if(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    """precision, recall, f1; null where there is nothing to divide by."""
    p, r = F.try_divide(F.col(tp), F.col(tp) + F.col(fp)), F.try_divide(F.col(tp), F.col(tp) + F.col(fn))
    return [p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1")]


def binary_confusion(rows: DataFrame, label: Column, predicted: Column, by: tuple[str, ...] = ()) -> DataFrame:
    g = rows.groupBy(*by).agg(n_if(label & predicted).alias("tp"), n_if(~label & predicted).alias("fp"), n_if(label & ~predicted).alias("fn"), n_if(~label & ~predicted).alias("tn"))
    return g.select(*by, "tp", "fp", "fn", "tn", *prf())


def same_cluster(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adds ``same`` (in one cluster) and ``covered`` (both ends clustered).  ``clusters``: (id, cluster_id)."""
    a, b = clusters.withColumnsRenamed({"id": "id_a", "cluster_id": "_ca"}), clusters.withColumnsRenamed({"id": "id_b", "cluster_id": "_cb"})
    both = pairs.join(a, "id_a", "left").join(b, "id_b", "left")
    return both.withColumn("same", F.coalesce(F.col("_ca") == F.col("_cb"), F.lit(False))).withColumn("covered", F.col("_ca").isNotNull() & F.col("_cb").isNotNull()).drop("_ca", "_cb")


def contingency(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(t, p, n) of two partitions (id, cluster_id) over their common ids."""
    return truth.withColumnRenamed("cluster_id", "t").join(predicted.withColumnRenamed("cluster_id", "p"), "id").groupBy("t", "p").agg(F.count(F.lit(1)).alias("n"))


def b_cubed(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(n, precision, recall, f1) by the contingency table, linear in the ids."""
    c = contingency(truth, predicted)
    t, p = c.groupBy("t").agg(F.sum("n").alias("nt")), c.groupBy("p").agg(F.sum("n").alias("np"))
    j = c.join(t, "t").join(p, "p")
    one = j.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / F.col("np")).alias("a"), F.sum(F.col("n") * F.col("n") / F.col("nt")).alias("b"))
    pr, rc = F.try_divide("a", "n"), F.try_divide("b", "n")
    return one.select("n", pr.alias("precision"), rc.alias("recall"), F.try_divide(2 * pr * rc, pr + rc).alias("f1"))


def cluster_recovery(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(status, lone, clusters): true clusters recovered exactly, split, merged or mixed; ``lone`` tells singletons."""
    c = contingency(truth, predicted)
    spread = c.groupBy("p").agg(F.countDistinct("t").alias("n_t"))
    per = c.join(spread, "p").groupBy("t").agg(F.countDistinct("p").alias("n_p"), F.max("n_t").alias("n_t"), F.sum("n").alias("size"))
    status = F.when((F.col("n_p") == 1) & (F.col("n_t") == 1), "exact").when(F.col("n_t") == 1, "split").when(F.col("n_p") == 1, "merged").otherwise("mixed")
    return per.select(status.alias("status"), (F.col("size") == 1).alias("lone")).groupBy("status", "lone").agg(F.count(F.lit(1)).alias("clusters"))


def closure_diagnostics(clusters: DataFrame, edges: DataFrame, negatives: DataFrame) -> DataFrame:
    """(implied, direct, contradicted): pairs the clusters imply, those with an edge, and labelled non-matches inside a cluster."""
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    implied = sizes.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("implied"))
    direct = same_cluster(edges.select("id_a", "id_b").distinct(), clusters).agg(n_if(F.col("same")).alias("direct"))
    bad = same_cluster(negatives.select("id_a", "id_b").distinct(), clusters).agg(n_if(F.col("same")).alias("contradicted"))
    return implied.crossJoin(direct).crossJoin(bad)


def size_histogram(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


def size_buckets(clusters: DataFrame) -> DataFrame:
    """(bucket, entities, records) for sizes 1, 2, 3, 4 and 5+."""
    s = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    b = F.when(F.col("n") >= 5, "5+").otherwise(F.col("n").cast("string"))
    return s.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("records"))


def headline(clusters: DataFrame) -> DataFrame:
    """(records, entities, absorbed, multi_share, largest)"""
    s = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("entities"), (F.sum("n") - F.count(F.lit(1))).alias("absorbed"), F.avg((F.col("n") > 1).cast("int")).alias("multi_share"), F.max("n").alias("largest"))


def severity(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(t, home, missing, foreign): the predicted cluster holding most of a true one, what lies elsewhere, and strangers in it."""
    c = contingency(truth, predicted)
    size_p, size_t = c.groupBy("p").agg(F.sum("n").alias("np")), c.groupBy("t").agg(F.sum("n").alias("nt"))
    home = c.withColumn("_r", F.row_number().over(Window.partitionBy("t").orderBy(F.col("n").desc(), "p"))).where("_r = 1")
    return home.join(size_p, "p").join(size_t, "t").select("t", F.col("p").alias("home"), (F.col("nt") - F.col("n")).alias("missing"), (F.col("np") - F.col("n")).alias("foreign"))


def route_confusion(routes: DataFrame) -> DataFrame:
    """The full grid (expected, system, n), zeros included.  ``routes``: (expected, system)."""
    spark = routes.sparkSession
    names = spark.createDataFrame([(r,) for r in ROUTES], "r string")
    grid = names.withColumnRenamed("r", "expected").crossJoin(names.withColumnRenamed("r", "system"))  # nine rows
    n = routes.groupBy("expected", "system").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["expected", "system"], "left").na.fill(0, ["n"])


def class_report(confusion: DataFrame) -> DataFrame:
    """(route, support, predicted, tp, precision, recall, f1); null recall without support."""
    support = confusion.groupBy(F.col("expected").alias("route")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("expected") == F.col("system"), F.col("n")).otherwise(0)).alias("tp"))
    called = confusion.groupBy(F.col("system").alias("route")).agg(F.sum("n").alias("predicted"))
    j = support.join(called, "route")
    p, r = F.try_divide("tp", "predicted"), F.try_divide("tp", "support")
    return j.select("route", "support", "predicted", "tp", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def report_averages(report: DataFrame) -> DataFrame:
    """(accuracy, and macro and support-weighted precision, recall and f1 over classes with support)"""
    s = report.where("support > 0")
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum(F.when(F.col(c).isNotNull(), F.col("support"))))
    return s.agg(F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"), *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def funnel(flags: DataFrame) -> DataFrame:
    """(stage, positives): labelled matches left after each stage.  ``flags``: label, candidate, rejected, gated, merged."""
    base = flags.where("label")
    one = base.agg(F.count(F.lit(1)).alias("labelled"), n_if(F.col("candidate")).alias("blocked"), n_if(F.col("candidate") & ~F.col("rejected")).alias("not_rejected"), n_if(F.col("candidate") & ~F.col("rejected") & ~F.col("gated")).alias("past_gate"), n_if(F.col("merged")).alias("merged"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("positives")) for s in ("labelled", "blocked", "not_rejected", "past_gate", "merged")])))


def loss_attribution(flags: DataFrame) -> DataFrame:
    """(stage, lost): unmerged labelled matches by the first stage that lost them."""
    stage = F.when(~F.col("candidate"), "blocking").when(F.col("rejected"), "rules").when(F.col("gated"), "gate").otherwise("matcher")
    return flags.where("label and not merged").groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("lost"))


def transitive_only(flags: DataFrame) -> DataFrame:
    """(kind, tp, fp, ...): merged pairs with an edge of their own and those merged through others."""
    merged = flags.where("merged").withColumn("kind", F.when(F.col("direct"), "direct").otherwise("transitive"))
    return binary_confusion(merged, F.col("label"), F.lit(True), ("kind",))


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(positives, negatives, auc) by the rank sum with ties averaged.

    Ranks come from counts per distinct score, so ties cost one row.
    """
    s = rows.groupBy(F.col(score).alias("s")).agg(n_if(F.col(label)).alias("pos"), n_if(~F.col(label)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = s.select("pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("u"))
    return u.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum("u").alias("u")).select("positives", "negatives", F.try_divide("u", F.col("positives") * F.col("negatives")).alias("auc"))


def pr_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Average precision: the step-wise area, equal scores taken together."""
    s = rows.groupBy(F.col(score).alias("s")).agg(n_if(F.col(label)).alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = s.select("pos", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("k"))
    return run.agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("k")), F.sum("pos")).alias("pr_auc"))


def calibration(rows: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """(bin, n, predicted, actual)"""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("predicted"), F.avg(F.col(label).cast("int")).alias("actual"))


def expected_calibration_error(rows: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    c = calibration(rows, bins, score, label)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("predicted") - F.col("actual"))) / F.sum("n")).alias("ece"))


def threshold_table(rows: DataFrame, cuts: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """(cut, tp, fp, fn, tn, precision, recall, f1) for every cut in one pass."""
    grid = rows.select(F.col(score).alias("s"), F.col(label).alias("y"), F.explode(F.array(*[F.lit(c) for c in cuts])).alias("cut"))
    return binary_confusion(grid, F.col("y"), F.col("s") >= F.col("cut"), ("cut",))


def threshold_for_precision(table: DataFrame, target: float) -> DataFrame:
    """The least cut that reaches the precision, with its recall."""
    return table.where(F.col("precision") >= target).orderBy("cut").limit(1).select("cut", "precision", "recall")


def by_stratum(rows: DataFrame, by: str, label: Column, predicted: Column) -> DataFrame:
    return binary_confusion(rows, label, predicted, (by,))


def bootstrap_precision(verdicts: DataFrame, resamples: int = 2000, seed: int = 42, exact: int = 1000) -> DataFrame:
    """(match_rule, decided, precision, low, high): 95 % percentile interval of precision by the bootstrap.

    ``verdicts``: (match_rule, verdict); only SAME and DIFFERENT are decided
    and resampled.  The correct pairs of a resample of n are binomial in n and
    the precision: n hash draws are counted up to ``exact`` pairs, beyond which
    the normal approximation is drawn.  Rules without decided pairs have nulls.
    """
    v = verdicts.groupBy("match_rule").agg(n_if(F.col("verdict") == "SAME").alias("good"), n_if(F.col("verdict").isin("SAME", "DIFFERENT")).alias("decided"))
    v = v.withColumn("precision", F.try_divide("good", "decided"))
    draws = v.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))  # rules x resamples
    unit = lambda *salt: (F.pmod(F.xxhash64("match_rule", "b", F.lit(seed), *salt), F.lit(1 << 40)) + 0.5) / (1 << 40)
    counted = F.aggregate(F.sequence(F.lit(1), F.greatest("decided", F.lit(1))), F.lit(0), lambda n, i: n + (unit(i) < F.col("precision")).cast("int"))
    spread = F.sqrt(F.col("decided") * F.col("precision") * (1 - F.col("precision")))
    normal = F.sqrt(-2 * F.log(unit(F.lit("r")))) * F.cos(2 * 3.141592653589793 * unit(F.lit("a")))
    approximate = F.greatest(F.lit(0.0), F.least(F.col("decided").cast("double"), F.round(F.col("good") + spread * normal)))
    drawn = draws.withColumn("p", F.try_divide(F.when(F.col("decided") <= exact, counted.cast("double")).otherwise(approximate), F.col("decided")))
    return drawn.groupBy("match_rule").agg(F.first("decided").alias("decided"), F.first("precision").alias("precision"), F.percentile("p", 0.025).alias("low"), F.percentile("p", 0.975).alias("high"))


def value_fan_out(records: DataFrame, column: str) -> DataFrame:
    """(value, n) of values that several records share."""
    return records.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.countDistinct("rec_id").alias("n")).where("n > 1")


def match_stats(matches: DataFrame, clusters: DataFrame) -> DataFrame:
    """(pairs, mean_confidence, suspicious_rate, clusters, covered); of matches, or of ``spanning_edges`` that totalled them."""
    if "is_suspicious" not in matches.columns:
        share = lambda c: F.try_divide(F.sum(c), F.sum("n"))
        m = matches.where("n is not null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), share("confidence").alias("mean_confidence"), share("suspicious").alias("suspicious_rate"))
        return m.crossJoin(_multiple(clusters))
    m = matches.agg(F.count(F.lit(1)).alias("pairs"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("is_suspicious").cast("int")).alias("suspicious_rate"))
    return m.crossJoin(_multiple(clusters))


def _multiple(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("covered"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rows, nulls, distinct)"""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[x for c in columns for x in (F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_0"), F.countDistinct(c).alias(f"{c}_d"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"{c}_0").alias("nulls"), F.col(f"{c}_d").alias("distinct")) for c in columns])))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def agreement_correlation(g: DataFrame, fields: list[str], top: int = 8) -> DataFrame:
    """(field_a, field_b, r): strongest correlations of field agreement."""
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    one = g.agg(*[F.corr((F.col(f"gamma_{a}") == 1).cast("double"), (F.col(f"gamma_{b}") == 1).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return one.select(F.inline(rows)).where("r is not null").orderBy(F.abs("r").desc(), "field_a", "field_b").limit(top)
