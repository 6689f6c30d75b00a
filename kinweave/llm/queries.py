"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinweave.llm.common import read_table, text_or_empty
from kinweave.llm.decontaminate import benchmark_matches
from kinweave.llm.line_dedup import dedup_lines
from kinweave.llm.minhash import fingerprint_documents, minhash_classes
from kinweave.llm.mixing import Target, mix_sources
from kinweave.llm.quality import score_quality
from kinweave.llm.sharding import shard_rows
from kinweave.llm.simhash import simhash_components
from kinweave.llm.token_files import token_digests, write_tokens
from kinweave.llm.toxicity import score_toxicity
from kinweave.llm.url_filters import filter_urls

END_ID = 1
SHARDS = 24
URL_RULES = "values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')"


def op1_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_digests(spark, write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed sequence in which no source is read more than four times and every document at least once."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, Target(repeats=4.0))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, deleted lines, maximal repeated runs and the longest of them, and the SHA-256 of what is left."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_lines=2, min_words=25).select(
        "doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", F.sha2("text", 256).alias("kept_sha256")
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_components(docs, radius=2, width=3).select("doc_id", "fingerprint", "component_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items each contaminated document holds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return benchmark_matches(docs, read_table(spark, sf_dir, "benchmark"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate classes behind op8's fingerprints: bands of signatures joined, Jaccard similarity of 0.8 verified."""
    return minhash_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"), similarity=0.8)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: the permutation deals single rows, so equal texts need not share a shard."""
    text = text_or_empty(F.col("text"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(docs, ["doc_id"], SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no"
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.sql(f"select * from {URL_RULES} as rules(host, path, verdict)")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simple8b": op1_simple8b,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_minhash": op8_minhash,
    "op9_sharding": op9_sharding,
    "op10_url_filter": op10_url_filter,
    "minhash_classes": classes,
}

# every pair of equal lines, joined to stretches along its diagonal: maximal repeats by definition, without any suffix array
OP5_SQL = """
with lines as (
    select doc_id, i - 1 as line, l, length(regexp_replace(l, '\\S+', 'x', 'g')) - length(regexp_replace(l, '\\S+', '', 'g')) as words
    from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
), pairs as (
    select a.doc_id, a.line, a.words, b.doc_id as other, a.line - b.line as diagonal
    from lines a join lines b on a.l = b.l and (b.doc_id < a.doc_id or (b.doc_id = a.doc_id and b.line < a.line))
), placed as (
    select *, line - row_number() over (partition by doc_id, other, diagonal order by line) as stretch from pairs
), stretches as (
    select doc_id, min(line) as s, max(line) + 1 as e from placed group by doc_id, other, diagonal, stretch having count(*) >= 2 and sum(words) > 0
    union
    select doc_id, line, line + 1 from pairs where words >= 25
), reached as (
    select *, max(e) over (partition by doc_id order by s, e desc rows between unbounded preceding and 1 preceding) as reach from stretches
), runs as (
    select doc_id, count(*) as n_runs, max(e - s) as longest_run from reached where reach is null or reach < e group by doc_id
), kept as (
    select doc_id, string_agg(l, chr(10) order by line) filter (not gone) as text, count(*) filter (gone) as n_deleted
    from (select lines.*, exists (select 1 from stretches x where x.doc_id = lines.doc_id and x.s <= lines.line and lines.line < x.e) as gone from lines)
    group by doc_id
)
select d.doc_id, cast(coalesce(len(string_split(d.text, chr(10))), 0) as integer) as n_lines, cast(coalesce(n_deleted, 0) as integer) as n_deleted,
       cast(coalesce(n_runs, 0) as integer) as n_runs, cast(coalesce(longest_run, 0) as integer) as longest_run,
       case when d.text is not null then sha256(coalesce(kept.text, '')) end as kept_sha256
from documents d left join runs using (doc_id) left join kept using (doc_id)
"""

OP10_SQL = f"""
with rules(host, path, verdict) as ({URL_RULES}),
parts as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from parts
)
select page_id, host, path,
       (select max_by(r.host || r.path, length(r.host || r.path)) from rules r where (split.host = r.host or ends_with(split.host, '.' || r.host)) and starts_with(split.path, r.path)) as rule,
       coalesce((select max_by(r.verdict, length(r.host || r.path)) from rules r where (split.host = r.host or ends_with(split.host, '.' || r.host)) and starts_with(split.path, r.path)), 'allow') as verdict
from split
"""

# every pair of texts that share a shingle, by the sizes of the sets
CLASSES_SQL = """
with recursive docs as (
    select doc_id, [x for x in string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\v\\f\\r]+') if x <> ''] as w from documents
), shingles as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') as s from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from docs where len(w) > 0)
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), common as (
    select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), links as (
    select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where k >= 0.8 * (x.n + y.n - k) - 1e-9
    union all
    select (select min(doc_id) from docs where len(w) = 0), doc_id from docs where len(w) = 0
), both_ways as (
    select a, b from links union select b, a from links union select doc_id, doc_id from docs
), reach as (
    select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a
)
select a as doc_id, min(b) as class_id from reach group by a
"""

ORACLES: dict[str, str] = {"minhash_classes": CLASSES_SQL, "op5_line_dedup": OP5_SQL, "op10_url_filter": OP10_SQL}
