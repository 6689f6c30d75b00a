"""Similarity of two values, as Column expressions; Jaro-Winkler is an Arrow UDF over distinct pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

NAME_CUT = 0.92


def jaro_winkler(a: str | None, b: str | None) -> float | None:
    """Jaro-Winkler similarity with a prefix of four and the usual weight 0.1; null if either is null."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(0, max(la, lb) // 2 - 1)
    taken, found = [False] * lb, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                found.append(c)
                break
    m = len(found)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(found, (b[j] for j in range(lb) if taken[j]))) // 2
    jaro = (m / la + m / lb + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, la, lb) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple, float | None] = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = jaro_winkler(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype=float)


def jaro_winkler_of(a: Column, b: Column) -> Column:
    """``jaro_winkler`` as an expression: slower for each pair than the UDF, for places where few rows get to it."""
    la, lb = F.length(a), F.length(b)
    reach = F.greatest(F.lit(0), F.floor(F.greatest(la, lb) / 2).cast("int") - 1)
    char = lambda s, i: F.substr(s, i, F.lit(1))

    def step(state: Column, i: Column) -> Column:
        near = F.filter(F.sequence(F.lit(1), lb), lambda j: (j >= i - reach) & (j <= i + reach) & ~F.array_contains(state["taken"], j) & (char(b, j) == char(a, i)))
        return F.when(F.size(near) == 0, state).otherwise(F.struct(F.array_append(state["taken"], F.get(near, F.lit(0))).alias("taken"), F.array_append(state["found"], char(a, i)).alias("found")))

    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<string>").alias("found"))

    def whole(state: Column) -> Column:
        m = F.size(state["taken"])
        apart = F.size(F.filter(F.zip_with(state["found"], F.transform(F.array_sort(state["taken"]), lambda j: char(b, j)), lambda x, y: x != y), lambda t: t))
        jaro = (m / la + m / lb + (m - F.floor(apart / 2)) / m) / 3
        prefix = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(4), la, lb)), F.lit(0), lambda n, i: F.when((n == i - 1) & (char(a, i) == char(b, i)), i).otherwise(n))
        return F.when(m == 0, 0.0).otherwise(F.when(jaro > 0.7, jaro + prefix * F.lit(0.1) * (1 - jaro)).otherwise(jaro))

    return F.when(a == b, 1.0).when(a.isNotNull() & b.isNotNull(), F.when((la == 0) | (lb == 0), 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), la), start, step, whole)))


def with_jaro_winkler(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Add the similarity of two columns; equal values need no UDF, others are scored once for each distinct pair."""
    unlike = df.select(F.col(left).alias("_a"), F.col(right).alias("_b")).where("_a <> _b").distinct()
    scored = unlike.withColumn("_jw", jaro_winkler_udf("_a", "_b"))
    joined = df.join(scored, (df[left] == scored["_a"]) & (df[right] == scored["_b"]), "left")
    return joined.withColumn(out, F.when(F.col(left) == F.col(right), 1.0).otherwise(F.col("_jw"))).drop("_a", "_b", "_jw")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def within_one_edit(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance of at most one: an edit, or a swap of neighbours."""
    swaps = F.exists(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - 1)),
        lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b,
    )
    return (F.levenshtein(a, b, 1) >= 0) | ((F.length(a) == F.length(b)) & (F.length(a) >= 2) & swaps)


def names_agree(a: Column, b: Column, jw: Column) -> Column:
    """Equal, similar by Jaro-Winkler, or one edit apart; false if either is null."""
    return F.coalesce((a == b) | (jw >= NAME_CUT) | within_one_edit(a, b), F.lit(False))


def names_agree_of(a: Column, b: Column) -> Column:
    """As ``names_agree``, the dearer tests only where the cheaper ones fail."""
    return F.when(a == b, True).when(a.isNull() | b.isNull(), False).when(within_one_edit(a, b), True).otherwise(jaro_winkler_of(a, b) >= NAME_CUT)


def token_jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def digit_agreement(a: Column, b: Column) -> Column:
    """Share of positions with equal characters, of the longer length; null if either is null."""
    n = F.greatest(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b)))), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))))
    return F.when(a.isNull() | b.isNull(), None).when((a == "") | (b == ""), 0.0).otherwise(same / n)


def best_of_values(a: Column, b: Column) -> Column:
    """Best Jaro-Winkler similarity over the cross product of two short arrays; null if either is empty."""
    return _best(a, b)


@F.pandas_udf(T.DoubleType())
def _best(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([max((jaro_winkler(x, y) for x in p for y in q), default=None) if p is not None and q is not None else None for p, q in zip(a, b)], dtype=float)


def street_number(address: Column) -> Column:
    found = F.regexp_extract(address, r"(\d+)", 1)
    return F.when(found != "", found)


def same_or_missing(a: Column, b: Column) -> Column:
    """'same', 'different', or 'missing' if either side is null."""
    return F.when(a.isNull() | b.isNull(), "missing").when(a == b, "same").otherwise("different")


def plain_value(c: Column) -> Column:
    """Trimmed and lower-cased; the usual words for nothing become null."""
    text = F.lower(F.trim(c))
    return F.when(~text.isin("", "nan", "none", "null", "na", "n/a", "unknown"), text)


def date_similarity(a: Column, b: Column) -> Column:
    return levenshtein_similarity(F.date_format(a, "yyyyMMdd"), F.date_format(b, "yyyyMMdd"))


def evaluator_similarity(a: Column, b: Column, jw: Column) -> Column:
    """1 if equal, 0.92 if one holds the other, else Jaro-Winkler."""
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.92).otherwise(jw)


def dates_match(a: Column, b: Column) -> Column:
    """Equal, or month and day exchanged."""
    swapped = (F.year(a) == F.year(b)) & (F.month(a) == F.day(b)) & (F.day(a) == F.month(b))
    return F.coalesce((a == b) | swapped, F.lit(False))


def dates_nearly_match(a: Column, b: Column) -> Column:
    """A match, or one day or one month off in the same year."""
    near = (F.year(a) == F.year(b)) & (
        ((F.month(a) == F.month(b)) & (F.abs(F.day(a) - F.day(b)) <= 1)) | ((F.day(a) == F.day(b)) & (F.abs(F.month(a) - F.month(b)) <= 1))
    )
    return dates_match(a, b) | F.coalesce(near, F.lit(False))


def share_value(a: Column, b: Column) -> Column:
    """Whether two arrays have a value in common; false for null or empty arrays."""
    single = (F.size(a) == 1) & (F.size(b) == 1)
    return F.when(single, F.get(a, F.lit(0)).eqNullSafe(F.get(b, F.lit(0)))).otherwise(F.coalesce(F.size(F.array_intersect(a, b)) >= 1, F.lit(False)))


def pair_bucket(a: Column, b: Column, salt: str) -> Column:
    """A number in [0, 1) from the first 8 bytes of SHA-256 of 'a|b|salt', the same whatever the engine."""
    head = F.substring(F.sha2(F.concat_ws("|", a, b, F.lit(salt)), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_odds2(p: Column) -> Column:
    """log2(p / (1 - p)) with p kept 1e-12 away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.log2(q / (1 - q))


def from_log_odds2(w: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(2.0), -w))


def agreement(a: Column, b: Column) -> Column:
    """'both_missing', 'one_missing', 'equal' or 'differ'."""
    return (
        F.when(a.isNull() & b.isNull(), "both_missing").when(a.isNull() | b.isNull(), "one_missing").when(a == b, "equal").otherwise("differ")
    )


def set_agreement(a: Column, b: Column) -> Column:
    """As ``agreement`` for arrays: equal if they share a value, missing if empty."""
    none = lambda x: x.isNull() | (F.size(x) == 0)
    return F.when(none(a) & none(b), "both_missing").when(none(a) | none(b), "one_missing").when(share_value(a, b), "equal").otherwise("differ")


def display_status(a: Column, b: Column) -> Column:
    """For showing a text field of two records: 'exact' (but for case and outer blanks), 'different' or 'missing' (null or empty)."""
    none = lambda x: x.isNull() | (x == "")
    return F.when(none(a) | none(b), "missing").when(F.lower(F.trim(a)) == F.lower(F.trim(b)), "exact").otherwise("different")


def shown_values(values: Column) -> Column:
    """The distinct trimmed values of an array that are not empty, sorted; an empty array for null."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != "")))


def display_sets(a: Column, b: Column) -> Column:
    """As ``display_status`` for sets of values; sets that overlap without being equal are 'partial'."""
    x, y = shown_values(a), shown_values(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), "missing").when(x == y, "exact").when(F.arrays_overlap(x, y), "partial").otherwise("different")


MERGED = ("auto_merge_rule", "ml_auto_merge")
LEANS, UNCERTAIN, IMPLAUSIBLE = 0.4, 0.2, 0.2


def signal(verdict: Column, confidence: Column, ml: Column, gate: Column) -> Column:
    """struct(band, score, origin): how a pair's evidence is presented.

    The verdict chooses the axis.  A rejected or gate-dropped pair is on the
    gate's: 'implausible' or 'unlikely' by the gate score.  Any other is on the
    match axis, by the rule's confidence or else the matcher's score:
    'confident' if a stage merged it, else 'leans', 'uncertain' or 'ambiguous'.
    """
    score = F.coalesce(confidence, ml)
    origin = F.when(confidence.isNotNull(), "rule").when(ml.isNotNull(), "model").otherwise("none")
    dropped = F.coalesce(verdict == "gate_dropped", F.lit(False))
    rejected = F.coalesce(verdict == "reject", F.lit(False))
    band = (
        F.when(rejected, "implausible").when(dropped, F.when(gate >= IMPLAUSIBLE, "unlikely").otherwise("implausible"))
        .when(verdict.isin(*MERGED), "confident").when(score >= LEANS, "leans").when(score >= UNCERTAIN, "uncertain").otherwise("ambiguous")
    )
    shown = F.when(rejected, F.lit(None)).when(dropped, gate).otherwise(score)
    source = F.when(rejected, "none").when(dropped, F.when(gate.isNull(), "none").otherwise("gate")).otherwise(origin)
    return F.struct(band.alias("band"), shown.alias("score"), source.alias("origin"))
