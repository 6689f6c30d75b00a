"""Review, diagnosis and reporting over pairs: searches, routes, stage metrics, comparisons of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.functions.similarity import shown_values
from kinweave.operators.components import connected_components
from kinweave.operators.metrics import binary_confusion, n_if, prf
from kinweave.operators.rules import AUTO, NO_MATCH, REVIEW

RESOLVED = ("auto_merge_rule", "ml_auto_merge", "reject", "gate_dropped")


def unresolved(verdict: Column) -> Column:
    """Pairs that no stage has settled; a pair without a verdict is one."""
    return verdict.isNull() | ~verdict.isin(*RESOLVED)


def _holds_all(words: list[str], *columns: str) -> Column:
    hit = F.lit(True)
    for w in words:
        some = F.lit(False)
        for c in columns:
            some = some | F.coalesce(F.lower(F.col(c)).contains(w), F.lit(False))
        hit = hit & some
    return hit


def search_pairs(pairs: DataFrame, records: DataFrame, words: str) -> DataFrame:
    """The pairs of which one and the same side has every word in its id, first or last name; all pairs without words.

    Null names hold nothing; ids without a record can only be found by the id.
    """
    tokens = words.lower().split()
    if not tokens:
        return pairs
    known = records.select("rec_id", "first", "last")
    both = pairs
    for s in "ab":
        both = both.join(known.withColumnsRenamed({"rec_id": f"id_{s}", "first": f"_first_{s}", "last": f"_last_{s}"}), f"id_{s}", "left")
    hit = [_holds_all(tokens, f"id_{s}", f"_first_{s}", f"_last_{s}") for s in "ab"]
    return both.where(hit[0] | hit[1]).select(*pairs.columns)


def entities_with_member(members: DataFrame, records: DataFrame, *, birth: str | None = None, last4: str | None = None) -> DataFrame:
    """(entity_id) of the entities that have a member born on a date, and one with the last four digits; the two may be different members."""
    out = members.select("entity_id").distinct()
    for test in [F.col("dob") == F.lit(birth).cast("date")] * (birth is not None) + [F.col("gov_id4") == last4] * (last4 is not None):
        out = out.join(members.join(records.where(test).select("rec_id"), "rec_id", "left_semi").select("entity_id"), "entity_id", "left_semi")
    return out


def best_confidence(own: DataFrame, prior: DataFrame) -> DataFrame:
    """(entity_id, confidence): the greater of a new score and the one an entity had; a null loses against any number."""
    both = own.select("entity_id", "confidence").unionByName(prior.select("entity_id", "confidence"))
    return both.groupBy("entity_id").agg(F.max("confidence").alias("confidence"))


def compare_records(records: DataFrame, group: str, fields: list[str], sets: tuple[str, ...] = ()) -> DataFrame:
    """(group, field, values): a field over all records of a group, in the order of rec_id, without judging them.

    Missing values are '(missing)'; sets are their sorted distinct values, joined by commas.
    """
    missing = lambda v: F.coalesce(F.nullif(v, F.lit("")), F.lit("(missing)"))
    cells = [F.struct(F.lit(f).alias("field"), missing(F.array_join(shown_values(F.col(f)), ", ") if f in sets else F.col(f).cast("string")).alias("value")) for f in fields]
    flat = records.select(group, "rec_id", F.explode(F.array(*cells)).alias("c")).select(group, "rec_id", "c.*")
    rows = flat.groupBy(group, "field").agg(F.array_sort(F.collect_list(F.struct("rec_id", "value"))).alias("v"))
    return rows.select(group, "field", F.transform("v", lambda x: x["value"]).alias("values"))


def cumulative_routes(pairs: DataFrame) -> DataFrame:
    """Adds after_rules, after_gate and after_ml to (blocked, rules_decision, gate_drop, ml_auto, ml_reject): the route behind each stage.

    A pair that blocking never made is no match; the gate and the matcher only move pairs that are still for review.
    """
    rules = F.when(F.col("blocked"), F.col("rules_decision")).otherwise(NO_MATCH)
    gate = F.when((F.col("after_rules") == REVIEW) & F.col("gate_drop"), NO_MATCH).otherwise(F.col("after_rules"))
    still = F.col("after_gate") == REVIEW
    ml = F.when(still & F.col("ml_reject"), NO_MATCH).when(still & F.col("ml_auto"), AUTO).otherwise(F.col("after_gate"))
    return pairs.withColumn("after_rules", rules).withColumn("after_gate", gate).withColumn("after_ml", ml)


def stage_metrics(labelled: DataFrame, stages: dict[str, tuple[str | None, str, str]]) -> DataFrame:
    """Confusion counts and rates of each stage over the pairs it saw.

    ``stages``: name -> (column that says whether the stage saw the pair, or
    None for all; column of its decision; column of its label).
    """
    cells = []
    for name, (seen, decided, label) in stages.items():
        own, y, x = F.col(seen) if seen else F.lit(True), F.col(label), F.col(decided)
        counts = {"tp": y & x, "fp": ~y & x, "fn": y & ~x, "tn": ~y & ~x}
        cells.append(F.struct(*[n_if(own & test).alias(c) for c, test in counts.items()], F.lit(name).alias("stage")))
    return labelled.agg(F.array(*cells).alias("_c")).select(F.inline("_c")).select("tp", "fp", "fn", "tn", *prf(), "stage")  # one pass over the pairs


def cut_cluster_sizes(pairs: DataFrame, cut: float, score: str = "score") -> DataFrame:
    """(size, clusters): sizes of the components that edges of at least ``cut`` make."""
    parts = connected_components(pairs.where(F.col(score) >= cut), "id_a", "id_b")
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


def segment_breakdown(scored: DataFrame, labels: DataFrame, cuts: list[float], score: str = "score") -> DataFrame:
    """(cut, segment, true_pairs, false_pairs, unlabelled): pairs at and above, or below, each cut by what their label says."""
    return segment_counts(scored.join(labels.select("id_a", "id_b", "label"), ["id_a", "id_b"], "left"), cuts, score)


def segment_counts(rows: DataFrame, cuts: list[float], score: str = "score") -> DataFrame:
    """As ``segment_breakdown`` for pairs that have their label (null: unlabelled); pairs are counted by score before they meet the cuts."""
    counts = rows.groupBy(F.col(score).alias("_s"), "label").agg(F.count(F.lit(1)).alias("_n")).withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts])))
    n = lambda test: F.sum(F.when(test, F.col("_n")).otherwise(0))
    return counts.groupBy("cut", F.when(F.col("_s") >= F.col("cut"), "above").otherwise("below").alias("segment")).agg(
        n(F.col("label")).alias("true_pairs"), n(~F.col("label")).alias("false_pairs"), n(F.col("label").isNull()).alias("unlabelled")
    )


def tier_by_source(tiers: DataFrame, labels: DataFrame) -> DataFrame:
    """Confusion of the automatic tier for each source of labels (id_a, id_b, origin, label)."""
    return source_confusion(labels.join(tiers.select("id_a", "id_b", "tier"), ["id_a", "id_b"], "left"))


def source_confusion(rows: DataFrame) -> DataFrame:
    """As ``tier_by_source`` for pairs that have origin, label and tier."""
    return binary_confusion(rows, F.col("label"), F.coalesce(F.col("tier") == AUTO, F.lit(False)), ("origin",))


def tier_label_table(tiers: DataFrame, label: str = "label") -> DataFrame:
    """(tier, positives, negatives) of labelled pairs, every tier with a row."""
    spark = tiers.sparkSession
    grid = spark.createDataFrame([(AUTO,), (REVIEW,), (NO_MATCH,)], "tier string")
    counts = tiers.groupBy("tier").agg(F.sum(F.col(label).cast("long")).alias("positives"), F.sum((~F.col(label)).cast("long")).alias("negatives"))
    return grid.join(F.broadcast(counts), "tier", "left").na.fill(0, ["positives", "negatives"])  # three rows at most


def select_tier(pairs: DataFrame, tier: str, column: str = "predicted_tier") -> DataFrame:
    return pairs.where(F.col(column) == tier)


def undecided_after_review(confirmed: DataFrame, undecided: DataFrame) -> DataFrame:
    """Pairs that reviewers confirmed and pairs nobody decided, one frame; ``origin`` says which."""
    return confirmed.select("id_a", "id_b", F.lit("review").alias("origin")).unionByName(undecided.select("id_a", "id_b", F.lit("open").alias("origin")))


def merge_labels(*sources: DataFrame) -> DataFrame:
    """(id_a, id_b, label): of several sources of labels the last one that has a pair decides; within one source the greatest label."""
    out = None
    for i, s in enumerate(sources):
        own = s.select("id_a", "id_b", F.col("label").cast("boolean").alias("label"), F.lit(i).alias("_rank"))
        out = own if out is None else out.unionByName(own)
    return out.where("label is not null").groupBy("id_a", "id_b").agg(F.max_by("label", F.struct("_rank", "label")).alias("label"))


def explanation_of(contributions: DataFrame, id_a: str, id_b: str) -> DataFrame:
    """(rank, feature, contribution, running): what moved one pair's score, largest first, with the running sum.

    ``contributions``: (id_a, id_b, feature, contribution), sorted by pair when
    stored, so the filter reaches the row groups.  A pair no model scored has no rows.
    """
    a, b = sorted((id_a, id_b))
    own = contributions.where((F.col("id_a") == a) & (F.col("id_b") == b))
    order = Window.orderBy(F.abs("contribution").desc(), "feature")  # the features of one pair
    return own.select("feature", "contribution", F.row_number().over(order).alias("rank"), F.sum("contribution").over(order).alias("running"))


def cleaned_mirror(records: DataFrame, run_id: str) -> DataFrame:
    """The published rows of cleaned records: text columns, the last four of the id only, and the run."""
    return records.select("rec_id", "first", "last", F.date_format("dob", "yyyy-MM-dd").alias("dob"), F.substring("gov_id", 6, 4).alias("gov_id4"), "email", "postal", F.array_join(F.array_sort("phones"), "|").alias("phones"), F.lit(run_id).alias("run_id"))
