"""The batch run: candidates, rules, gate, matcher, clusters, artifacts and their manifest in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from kinweave.operators import blocking as B, graph as G, linkage as L, pairs as P, rules as R
from kinweave.operators.qgram import qgram_pairs
from kinweave.sources.files import write_run
from kinweave.storage import materialize, scratch


@dataclass(frozen=True)
class Options:
    """What a run does; stages without a model are passed over."""

    qgram: bool = True  # also the fuzzy name blocker
    top_k: int | None = G.TOP_K  # edges kept for each record; None: all
    rules: tuple[R.Rule, ...] = R.RULES
    gate: L.Matcher | None = None
    fellegi_sunter: L.Parameters | None = None  # scores every candidate, and is the gate where there is no model
    matcher: L.Matcher | None = None
    matcher_feeds_clusters: bool = False
    gate_cut: float = L.GATE
    merge_cut: float = L.ML_AUTO


def link(records: DataFrame, options: Options = Options()) -> dict[str, DataFrame]:
    """The tables of a run by name, from cleaned records.

    ``candidates``, ``matches``, ``decisions`` (every candidate: auto_merge,
    human_review or no_match by the rules), ``pool`` (what is left for the
    matcher), ``outcome`` (every candidate with the verdict of the last stage
    that moved it) and ``clusters``; with models also ``fs`` , ``gate`` and
    ``matcher``.  Records that are not valid take no part.  The gate keeps
    pairs at and above its cut; without a gate model the pairs that
    Fellegi-Sunter does not call no match; without either all of them.
    """
    own = B.valid_records(records)
    pairs = B.candidate_pairs(own)
    if options.qgram:
        pairs = materialize(B.union_pairs(pairs, qgram_pairs(own)), "union")
    if options.top_k is not None:
        pairs = G.prune_top_k(G.arcs_weights(pairs).withColumn("weight", F.round("weight", 12)), options.top_k).select("id_a", "id_b", "blocks", "n_blocks")
    out = {"candidates": materialize(pairs, "candidates")}
    out["matches"] = materialize(R.apply_rules(out["candidates"], own, options.rules), "matches")
    out["decisions"] = materialize(R.three_way(out["candidates"], out["matches"], own), "decisions")
    open_ = out["candidates"].join(out["decisions"].where(F.col("decision") == R.REVIEW).select("id_a", "id_b"), ["id_a", "id_b"], "left_semi")
    if options.fellegi_sunter is not None:
        scored = L.score(out["candidates"], own, options.fellegi_sunter)
        out["fs"] = materialize(scored.withColumn("predicted_tier", L.fs_tier(F.col("match_probability"))), "fs")
    featured = materialize(L.features(open_, own), "features") if options.gate or options.matcher else None
    pool = open_
    if options.gate is not None:
        scores = options.gate.score(featured).select("id_a", "id_b", "score")
        out["gate"] = materialize(scores.withColumn("predicted_tier", F.when(F.col("score") >= options.gate_cut, R.REVIEW).otherwise(R.NO_MATCH)), "gate")
        pool = P.only(open_, out["gate"].where(F.col("predicted_tier") == R.REVIEW).select("id_a", "id_b"))
    elif options.fellegi_sunter is not None:
        pool = P.only(open_, out["fs"].where(F.col("predicted_tier") != R.NO_MATCH).select("id_a", "id_b"))
    out["pool"] = materialize(pool.select("id_a", "id_b"), "pool")
    merges = out["matches"].select("id_a", "id_b")
    if options.matcher is not None:
        scores = options.matcher.score(featured.join(out["pool"], ["id_a", "id_b"], "left_semi")).select("id_a", "id_b", "score")
        out["matcher"] = materialize(scores.withColumn("predicted_tier", F.when(F.col("score") >= options.merge_cut, R.AUTO).otherwise(R.REVIEW)), "matcher")
        if options.matcher_feeds_clusters:
            merges = merges.unionByName(out["matcher"].where(F.col("predicted_tier") == R.AUTO).select("id_a", "id_b"))
    verdict = out["decisions"].select("id_a", "id_b", "decision").join(out["pool"].withColumn("kept", F.lit(True)), ["id_a", "id_b"], "left")
    tier = F.lit(None).cast("string")
    if "matcher" in out:
        verdict = verdict.join(out["matcher"].select("id_a", "id_b", F.col("predicted_tier").alias("tier")), ["id_a", "id_b"], "left")
        tier = F.col("tier")
    named = (
        F.when(F.col("decision") == R.AUTO, "auto_merge_rule").when(F.col("decision") == R.NO_MATCH, "reject").when(F.col("kept").isNull(), "gate_dropped")
        .when(tier == R.AUTO, "ml_auto_merge").when(tier.isNotNull(), "ml_human_review").otherwise("undecided")
    )
    out["outcome"] = verdict.select("id_a", "id_b", named.alias("verdict"))
    out["clusters"] = G.assign_clusters(own, merges)
    return out


def run_batch(records: DataFrame, folder: str, run_id: str, options: Options = Options()) -> dict:
    """Runs ``link``, writes every table below ``folder/run_id`` with a manifest of counts and hashes, and returns the manifest."""
    with scratch():
        return write_run(folder, run_id, link(records, options))


def stage_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(stage, n): the candidates of a run, and how many of them each verdict got."""
    all_ = tables["candidates"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("candidates").alias("stage"), "n")
    return all_.unionByName(tables["outcome"].groupBy(F.col("verdict").alias("stage")).agg(F.count(F.lit(1)).alias("n")))
