"""URL filtering by host-suffix and path-prefix rules.

Each URL is expanded into the combinations of its host suffixes and path
prefixes, as lookups of blocked-site lists do.  The expressions are equi-joined
with the rules on a short prefix of their SHA-256 digest; the full digests
confirm a hit, and the longest rule wins.  Only as many labels and characters
as some rule has are expanded, so a URL gives (label counts) x (path lengths)
expressions at most: they grow with the distinct lengths among the rules.  Everything is an SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.llm.common import join_hot, without

PREFIX_HEX = 8  # 32 bits of the digest
SALTS = 32
BROADCAST_RULES = 20_000

RULE_SCHEMA = "host string, path string, verdict string"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first ``://`` and ``/``, ``?``, ``#``, A-Z lower-cased; path up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\u0001"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``.

    ``rules``: host, path, verdict ('allow' or 'block').  A rule fits its host
    and all subdomains if the URL's path starts with the rule's path; the
    longest rule (host and path together) wins, then the longer host, then
    block over allow.  A rule with a null host or verdict is no rule; a null
    path is the empty path.  URLs that are null or have no ``://`` have empty
    host and path, fit no rule and get ``default``, as does any URL without a
    fitting rule.  Repeated rows are judged alike; other columns are kept, and
    input columns named like the added ones are replaced.
    """
    pages = without(pages, "host", "path", "rule", "verdict", "__kw_n", "__kw_hot", "__kw_salt")
    host, path = url_parts(F.col(f"`{url}`"))
    # rule hosts are compared with lower-cased hosts, and a path not starting with / fits nothing
    known = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host is not null and verdict in ('allow', 'block') and (path = '' or startswith(path, '/'))")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block > allow
        .select(
            F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_len"),
            F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_len"), _digest(F.col("host"), F.col("path")).alias("digest"),
        )
    )
    # bounded by the longest host and path of a rule, not by the number of rules
    shape = known.agg(F.collect_set("labels").alias("l"), F.collect_set("path_len").alias("p"), F.count(F.lit(1)).alias("n")).first()
    judged = pages.select("*", host.alias("host"), path.alias("path"))
    if not shape["n"]:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    counted = judged.groupBy("host", "path").agg(F.count(F.lit(1)).alias("__kw_n"))
    urls = counted.where("host <> '' or path <> ''").select("host", "path")
    labels = ", ".join(map(str, sorted(shape["l"])))
    lengths = ", ".join(map(str, sorted(shape["p"])))
    suffixes = f"transform(filter(array({labels}), k -> k <= size(parts)), k -> array_join(slice(parts, -k, k), '.'))"
    prefixes = f"transform(filter(array({lengths}), k -> k <= length(path)), k -> left(path, k))"
    expressions = (
        urls.withColumn("parts", F.split("host", r"\."))
        .selectExpr("host", "path", f"explode({suffixes}) as suffix", f"{prefixes} as prefixes")
        .selectExpr("host", "path", "suffix", "explode(prefixes) as prefix")
        .select("host", "path", _digest(F.col("suffix"), F.col("prefix")).alias("full"))
        .withColumn("short", F.substring("full", 1, PREFIX_HEX))
    )
    known = known.withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    if shape["n"] <= BROADCAST_RULES:  # counted above
        joined = expressions.join(F.broadcast(known), "short")
    else:  # a rule such as a top-level domain can fit a third of all URLs: copies of the rules per salt spread it
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = expressions.withColumn("salt", F.expr(f"cast(pmod(xxhash64(host, path), {SALTS}) as int)")).join(salted, ["short", "salt"])
    best = (
        joined.where("full = digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "host_len", F.col("verdict"), F.col("rule"))).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    # one URL, or the rows without any, may be a third of all
    return join_hot(judged, best, ["host", "path"], "__kw_n", pages.count(), "left", counted).select(
        *[f"`{c}`" for c in judged.columns], "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
