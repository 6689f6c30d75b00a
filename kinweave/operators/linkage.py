"""Fellegi-Sunter scoring and the feature vector of the trained matchers."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from kinweave.functions.similarity import (
    best_of_values, date_similarity, digit_agreement, from_log_odds2, jaro_winkler_udf, levenshtein_similarity, log_odds2, plain_value, same_or_missing, share_value, street_number, token_jaccard, with_jaro_winkler,
)
from kinweave.functions.phonetic import metaphone_udf, with_code
from kinweave.operators import compared
from kinweave.operators.blocking import met_in_groups
from kinweave.operators.pairs import attach
from kinweave.operators.rules import AUTO, NO_MATCH, REVIEW
from kinweave.storage import materialize

FS_AUTO, FS_REVIEW, ML_AUTO, GATE = 0.95, 0.40, 0.70, 0.30
BUMP_FROM, BUMP_MOST, PRIOR_RECALL = 2, 4.0, 0.9


@dataclass(frozen=True)
class Comparison:
    """A field compared at three levels: null (-1), exact (1), else (0)."""

    field: str
    is_set: bool = False
    term_frequency: bool = False

    def gamma(self) -> Column:
        left, right = F.col(f"{self.field}_l"), F.col(f"{self.field}_r")
        if self.is_set:
            none = left.isNull() | right.isNull() | (F.size(left) == 0) | (F.size(right) == 0)
            return F.when(none, -1).when(share_value(left, right), 1).otherwise(0)
        return F.when(left.isNull() | right.isNull(), -1).when(left == right, 1).otherwise(0)


@dataclass(frozen=True)
class Registry:
    """An immutable list of comparisons."""

    items: tuple[Comparison, ...]

    def add(self, c: Comparison) -> Registry:
        if any(x.field == c.field for x in self.items):
            raise ValueError(f"{c.field} is already compared")
        return replace(self, items=(*self.items, c))

    def remove(self, field: str) -> Registry:
        return replace(self, items=tuple(x for x in self.items if x.field != field))

    def replace(self, c: Comparison) -> Registry:
        return replace(self, items=tuple(c if x.field == c.field else x for x in self.items))

    @property
    def fields(self) -> list[str]:
        return [x.field for x in self.items]


REGISTRY = Registry((Comparison("first", term_frequency=True), Comparison("last", term_frequency=True), Comparison("dob"), Comparison("gov_id"), Comparison("email", term_frequency=True), Comparison("phones", is_set=True), Comparison("addr")))


def gammas(pairs: DataFrame, records: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Pairs with ``gamma_<field>`` and the compared values."""
    both = attach(pairs, records, registry.fields)
    return both.withColumns({f"gamma_{c.field}": c.gamma() for c in registry.items})


def level_rates(g: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """(field, rate): share of exact agreement among pairs in which both sides are present."""
    one = g.agg(*[F.avg(F.when(F.col(f"gamma_{f}") >= 0, F.col(f"gamma_{f}"))).alias(f) for f in registry.fields])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("rate")) for f in registry.fields])))


def exact_u(records: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """(field, rate): the chance that two random records agree, exactly, from value counts: sum n(n-1) / N(N-1).

    For sets, the chance of a shared value is bounded by the sum over values; it
    is used as the estimate.
    """
    out = None
    for c in registry.items:
        v = records.select("rec_id", F.explode(c.field).alias("v") if c.is_set else F.col(c.field).alias("v")).where("v is not null")
        counts = v.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("n"))
        total = records.where(F.size(c.field) > 0 if c.is_set else F.col(c.field).isNotNull()).agg(F.count(F.lit(1)).cast("double").alias("t"))
        row = counts.agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("s")).crossJoin(total).select(F.lit(c.field).alias("field"), F.try_divide("s", F.col("t") * (F.col("t") - 1)).alias("rate"))
        out = row if out is None else out.unionByName(row)
    return out


@dataclass(frozen=True)
class Parameters:
    """m and u of every field, and the prior that two records match."""

    m: dict[str, float]
    u: dict[str, float]
    prior: float

    def inversions(self) -> list[str]:
        """Fields in which agreement would speak against a match."""
        return sorted(f for f in self.m if self.m[f] < self.u[f])


def prior_from_rules(records: DataFrame, recall: float = PRIOR_RECALL) -> float:
    """Pairs that any of five strict rules confirms, divided by the rules' recall and the number of pairs."""
    name_dob = ["first", "last", "dob"]
    flat = records.withColumn("phone", F.explode_outer("phones"))
    found = None
    for table, keys in ((records, ["gov_id", "dob"]), (records, [*name_dob, "email"]), (flat, [*name_dob, "phone"]), (records, [*name_dob, "sex"]), (records, [*name_dob, "addr"])):
        base = table.dropna(subset=keys)
        met = base.select(F.col("rec_id").alias("id_a"), *keys).join(base.select(F.col("rec_id").alias("id_b"), *keys), keys).where("id_a < id_b").select("id_a", "id_b")
        found = met if found is None else found.unionByName(met)
    n = records.count()
    return found.distinct().count() / recall / (n * (n - 1) / 2)


def estimate(pairs_true: DataFrame, records: DataFrame, registry: Registry = REGISTRY, floor: float = 1e-6) -> Parameters:
    """m from pairs known to match, u from the records' value counts, the prior from rules."""
    keep = lambda p: min(max(p if p is not None else 0.5, floor), 1 - floor)
    m = {r["field"]: keep(r["rate"]) for r in level_rates(gammas(pairs_true.select("id_a", "id_b"), records, registry), registry).collect()}
    u = {r["field"]: keep(r["rate"]) for r in exact_u(records, registry).collect()}
    return Parameters(m, u, keep(prior_from_rules(records)))


def term_frequencies(records: DataFrame, field: str) -> DataFrame:
    """(value, tf): share of each value among the present ones."""
    v = records.select(F.col(field).alias("value")).where("value is not null")
    total = v.agg(F.count(F.lit(1)).alias("t"))
    return v.groupBy("value").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("value", (F.col("n") / F.col("t")).alias("tf"))  # one row


def score(pairs: DataFrame, records: DataFrame, p: Parameters, registry: Registry = REGISTRY) -> DataFrame:
    """match_weight and match_probability with the gamma, Bayes factor and frequency adjustment of every field.

    weight = log2(prior odds) + sum of log2(m/u) + sum of log2(u/tf) of exact
    agreements with term frequencies; a null level adds nothing.
    """
    g = gammas(pairs, records, registry)
    weight = F.lit(float(np.log2(p.prior / (1 - p.prior))))
    for c in registry.items:
        m, u, gamma = p.m[c.field], p.u[c.field], F.col(f"gamma_{c.field}")
        g = g.withColumn(f"bf_{c.field}", F.when(gamma == 1, m / u).when(gamma == 0, (1 - m) / (1 - u)).otherwise(1.0))
        weight = weight + F.log2(F.col(f"bf_{c.field}"))
        if c.term_frequency:
            tf = term_frequencies(records, c.field).withColumnsRenamed({"value": f"{c.field}_l", "tf": f"_tf_{c.field}"})
            g = g.join(tf, f"{c.field}_l", "left").withColumn(f"tf_adj_{c.field}", F.when((gamma == 1) & F.col(f"_tf_{c.field}").isNotNull(), F.lit(u) / F.col(f"_tf_{c.field}")).otherwise(1.0))
            weight = weight + F.log2(F.col(f"tf_adj_{c.field}"))
    g = g.withColumn("match_weight", weight)
    own = [x for c in registry.items for x in (f"gamma_{c.field}", f"bf_{c.field}", *([f"tf_adj_{c.field}"] if c.term_frequency else []))]
    return g.select(*pairs.columns, "match_weight", from_log_odds2(F.col("match_weight")).alias("match_probability"), *own)


def block_bump(scored: DataFrame, start: int = BUMP_FROM, most: float = BUMP_MOST) -> DataFrame:
    """One bit of weight for every block beyond ``start``, ``most`` at the highest."""
    bits = F.least(F.greatest(F.col("n_blocks") - start, F.lit(0)).cast("double"), F.lit(most))
    weight = log_odds2(F.col("match_probability")) + bits
    return scored.withColumn("match_weight", weight).withColumn("match_probability", from_log_odds2(F.col("match_weight")))


def fs_tier(p: Column) -> Column:
    return F.when(p >= FS_AUTO, AUTO).when(p >= FS_REVIEW, REVIEW).otherwise(NO_MATCH)


def ml_tier(p: Column) -> Column:
    return F.when(p >= ML_AUTO, AUTO).otherwise(REVIEW)


def gate_tier(p: Column) -> Column:
    return F.when(p >= GATE, REVIEW).otherwise(NO_MATCH)


def gamma_patterns(g: DataFrame, registry: Registry = REGISTRY) -> DataFrame:
    """Counts of each combination of levels: at most 3**fields rows, whatever the number of pairs."""
    return g.groupBy(*[f"gamma_{f}" for f in registry.fields]).agg(F.count(F.lit(1)).alias("n"))


def expectation_maximisation(patterns: DataFrame, u: dict[str, float], registry: Registry = REGISTRY, prior: float = 0.1, rounds: int = 50) -> Parameters:
    """m and prior by EM over the pattern counts with u fixed; the driver holds only the pattern table."""
    rows = patterns.collect()
    g = np.array([[r[f"gamma_{f}"] for f in registry.fields] for r in rows], float).reshape(len(rows), len(registry.fields))
    n = np.array([r["n"] for r in rows], float)
    uu, m = np.array([u[f] for f in registry.fields]), np.full(len(registry.fields), 0.9)
    for _ in range(rounds):
        lm = np.where(g == 1, m, np.where(g == 0, 1 - m, 1)).prod(axis=1)
        lu = np.where(g == 1, uu, np.where(g == 0, 1 - uu, 1)).prod(axis=1)
        p = prior * lm / np.maximum(prior * lm + (1 - prior) * lu, 1e-300)
        seen = (g >= 0) * (n * p)[:, None]
        m = np.clip((seen * (g == 1)).sum(axis=0) / np.maximum(seen.sum(axis=0), 1e-12), 1e-6, 1 - 1e-6)
        prior = float(np.clip((n * p).sum() / max(n.sum(), 1), 1e-9, 1 - 1e-9))
    return Parameters(dict(zip(registry.fields, m.tolist())), dict(u), prior)


FEATURES = ["first_jw", "last_jw", "first_lev", "last_lev", "dob_sim", "id_agree", "postal_agree", "name_jaccard", "phone_best"]
CATEGORIES = ["email_cat", "street_cat", "sound_cat"]


COMPARED = ["first", "last", "dob", "gov_id", "postal", "email", "addr", "phones", "mp_last", "tokens"]


def tidied(records: DataFrame) -> DataFrame:
    """The records with the values that ``features`` compares."""
    tidy = records.withColumns({c: plain_value(F.col(c)) for c in ("first", "last", "gov_id", "postal", "email", "addr")})
    return with_code(tidy, "last", "mp_last", metaphone_udf).withColumn("tokens", F.array_sort(F.array_distinct(F.split(F.concat_ws(" ", "first", "last"), r"[ \-]+"))))


def features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Nine similarities (null where a side is missing) and three same/different/missing categories."""
    both = attach(pairs, tidied(records), COMPARED)
    both = with_jaro_winkler(with_jaro_winkler(both, "first_l", "first_r", "first_jw"), "last_l", "last_r", "last_jw")
    return _features(both, pairs.columns)


def features_of(both: DataFrame, *keep: str) -> DataFrame:
    """``features`` of pairs that have both sides of ``COMPARED``: names are compared as pairs pass by, so none are written or shuffled."""
    return _features(both.withColumn("first_jw", jaro_winkler_udf("first_l", "first_r")).withColumn("last_jw", jaro_winkler_udf("last_l", "last_r")), ["id_a", "id_b", *keep])


def features_in_groups(records: DataFrame, keys: dict[str, Column], label: str | None = None) -> DataFrame:
    """``features`` of the pairs that share a key, with ``label`` (whether both have the same value of that column): made in arrays, once for distinct values."""
    own = tidied(records).withColumns({c: F.col(c).cast("string") for c in ("first", "last", "gov_id", "postal", "email", "mp_last")})
    texts = {"dob": F.date_format("dob", "yyyyMMdd"), "street": street_number(F.col("addr")), "phones": F.when(F.size("phones") > 0, F.array_join("phones", compared.BREAK)), "tokens": F.array_join("tokens", " ")}
    carry = ("first", "last", "dob", "gov_id", "postal", "email", "street", "phones", "mp_last", "tokens", *([label] if label else []))
    named = own.select("rec_id", *[x.alias(f"_s{i}") for i, x in enumerate(keys.values())], *[texts[c].alias(c) if c in texts else F.col(c) for c in carry])
    schema = ", ".join(["id_a string", "id_b string", *[f"{c} double" for c in FEATURES], *[f"{c} string" for c in CATEGORIES], *(["label boolean"] if label else [])])
    return met_in_groups(named, {k: F.col(f"_s{i}") for i, k in enumerate(keys)}, carry, lambda own: compared.featured(own, label), schema)


def _features(both: DataFrame, keep: list[str]) -> DataFrame:
    x = lambda c: (F.col(f"{c}_l"), F.col(f"{c}_r"))
    return both.select(
        *keep, "first_jw", "last_jw", levenshtein_similarity(*x("first")).alias("first_lev"), levenshtein_similarity(*x("last")).alias("last_lev"),
        date_similarity(*x("dob")).alias("dob_sim"), digit_agreement(*x("gov_id")).alias("id_agree"), digit_agreement(*x("postal")).alias("postal_agree"),
        token_jaccard(*x("tokens")).alias("name_jaccard"), best_of_values(*x("phones")).alias("phone_best"), same_or_missing(*x("email")).alias("email_cat"),
        same_or_missing(street_number(F.col("addr_l")), street_number(F.col("addr_r"))).alias("street_cat"), same_or_missing(*x("mp_last")).alias("sound_cat"),
    )


def _parts() -> dict[str, Column]:
    cols = {f"_{f}": F.coalesce(F.col(f), F.lit(0.0)) for f in FEATURES} | {f"_{f}_none": F.col(f).isNull().cast("double") for f in FEATURES}
    return cols | {f"_{c}_{v}": (F.col(c) == v).cast("double") for c in CATEGORIES for v in ("same", "different")}


def vector(featured: DataFrame, scale: list[float] | None = None) -> DataFrame:
    """Adds ``x``: the similarities with 0 and a missing mark for null, and one-hot categories; divided by ``scale``."""
    from pyspark.ml.feature import VectorAssembler

    cols = _parts()
    if scale:
        cols = {n: c / F.lit(s) for (n, c), s in zip(cols.items(), scale)}
    return VectorAssembler(inputCols=list(cols), outputCol="x").transform(featured.withColumns(cols)).drop(*cols)


@dataclass
class Matcher:
    """A trained pair classifier: gradient-boosted trees, or logistic regression whose contributions are exact."""

    model: object
    names: list[str]
    kind: str
    scale: list[float] | None = None  # what the model's features are divided by

    def score(self, featured: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(vector(featured, self.scale))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("x", "probability", "rawPrediction", "prediction")

    def coefficients(self) -> list[float]:
        """Of a logistic model, for features that are not divided by anything."""
        own = self.model.coefficients.toArray().tolist()
        return [c / s for c, s in zip(own, self.scale)] if self.scale else own

    def contributions(self, featured: DataFrame, mean: list[float] | None = None, whole: bool = False) -> DataFrame:
        """(pair, feature, contribution): coefficient * (value - mean) of a logistic model, in log-odds; ``whole``: a row a pair, with the array ``parts``."""
        from pyspark.ml.functions import vector_to_array

        if self.kind != "logistic":
            raise ValueError("exact contributions need the logistic matcher")
        coefficients = self.coefficients()
        mean = mean or [0.0] * len(coefficients)
        x = vector(featured).select("id_a", "id_b", vector_to_array("x").alias("v"))
        parts = F.array(*[F.struct(F.lit(n).alias("feature"), (F.lit(c) * (F.col("v")[i] - F.lit(m))).alias("contribution")) for i, (n, c, m) in enumerate(zip(self.names, coefficients, mean))])
        return x.select("id_a", "id_b", parts.alias("parts")) if whole else x.select("id_a", "id_b", F.inline(parts))


def vector_names() -> list[str]:
    return [*FEATURES, *[f"{f}_none" for f in FEATURES], *[f"{c}_{v}" for c in CATEGORIES for v in ("same", "different")]]


def train_matcher(featured: DataFrame, label: str = "label", kind: str = "gbt", seed: int = 42, trees: int = 20) -> Matcher:
    """Trains on all rows with class weights that balance the labels.

    Rows alike in features and label are one row that weighs as many: the loss
    is the same, and what is stored grows with the kinds of rows.  The logistic
    model's features are divided by their deviation over all rows beforehand,
    since Spark's own would differ with the number of rows.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    kinds = materialize(featured.groupBy(*FEATURES, *CATEGORIES, label).agg(F.count(F.lit(1)).alias("_n")), "kinds", release=True)
    rates = kinds.where(F.col(label).isNotNull()).agg((F.sum(F.col(label).cast("double") * F.col("_n")) / F.sum("_n")).alias("r")).first()["r"]
    balance = F.when(F.col(label), 0.5 / max(rates, 1e-9)).otherwise(0.5 / max(1 - rates, 1e-9))
    data = vector(kinds).withColumn("_y", F.col(label).cast("double")).withColumn("_w", balance * F.col("_n"))
    if kind == "gbt":
        estimator = GBTClassifier(featuresCol="x", labelCol="_y", weightCol="_w", maxIter=trees, maxDepth=4, stepSize=0.1, seed=seed)
        return Matcher(estimator.fit(data), vector_names(), kind)
    scale = _deviations(kinds, balance)
    estimator = LogisticRegression(featuresCol="x", labelCol="_y", weightCol="_w", regParam=0.01, maxIter=50, standardization=False)
    return Matcher(estimator.fit(data.drop("x").transform(lambda df: vector(df, scale))), vector_names(), kind, scale)


def _deviations(kinds: DataFrame, weight: Column) -> list[float]:
    """The deviation of every feature over the rows that ``_n`` counts, unbiased for their weights; 1 where there is none."""
    cols, n = _parts(), F.col("_n")
    total = kinds.agg(F.sum(weight * n).alias("w"), F.sum(weight * weight * n).alias("ww"), *[F.sum(weight * n * c).alias(f"s{x}") for x, c in cols.items()]).first()
    if not total["w"]:
        return [1.0] * len(cols)
    off = kinds.agg(*[F.sum(weight * n * F.pow(c - F.lit(total[f"s{x}"] / total["w"]), 2)).alias(x) for x, c in cols.items()]).first()
    free = total["w"] - total["ww"] / total["w"]
    return [float(np.sqrt(off[x] / free)) if free > 0 and off[x] > 1e-12 * total["w"] else 1.0 for x in cols]


def waterfall(contributions: DataFrame, base: float = 0.0, top: int = 8) -> DataFrame:
    """Contributions ranked by size with the running total and its probability; the largest ``top`` of each pair."""
    from pyspark.sql import Window

    order = Window.partitionBy("id_a", "id_b").orderBy(F.abs("contribution").desc(), "feature")
    run = F.sum("contribution").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(base)
    ranked = contributions.withColumn("rank", F.row_number().over(order)).withColumn("running", run)
    return ranked.withColumn("probability", 1 / (1 + F.exp(-F.col("running")))).where(F.col("rank") <= top)


def waterfall_of(whole: DataFrame, base: float = 0.0, top: int = 8) -> DataFrame:
    """``waterfall`` of rows that hold all parts of their pair: each is ranked by itself, so nothing is shuffled."""
    ordered = F.array_sort(F.transform("parts", lambda p: F.struct((-F.abs(p["contribution"])).alias("size"), p["feature"].alias("feature"), p["contribution"].alias("contribution"))))
    start = F.struct(F.array().cast("array<struct<feature:string,contribution:double,rank:int,running:double>>").alias("rows"), F.lit(0.0).alias("total"))

    def step(state: Column, p: Column) -> Column:
        total = state["total"] + p["contribution"]
        row = F.struct(p["feature"].alias("feature"), p["contribution"].alias("contribution"), (F.size(state["rows"]) + 1).alias("rank"), (total + F.lit(base)).alias("running"))
        return F.struct(F.array_append(state["rows"], row).alias("rows"), total.alias("total"))

    ranked = whole.select("id_a", "id_b", F.inline(F.aggregate(F.slice(ordered, 1, top), start, step)["rows"]))
    return ranked.withColumn("probability", 1 / (1 + F.exp(-F.col("running"))))
