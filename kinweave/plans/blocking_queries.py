"""Queries of the blocking and graph operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions.phonetic import double_metaphone
from kinweave.operators import blocking as B, graph as G, qgram as Q
from kinweave.plans.fixture import codes_cte, first_codes_cte, person, with_person
from kinweave.plans.registry import query
from kinweave.storage import materialize


def _soundex(name: str) -> str:
    """Soundex of an upper-case name, for the SQL's code tables."""
    groups = {c: d for d, cs in {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}.items() for c in cs}
    out, last = name[0], groups.get(name[0], "")
    for c in name[1:]:
        d = groups.get(c, "")
        if d and d != last:
            out += d
        if c not in "HW":
            last = d
    return (out + "000")[:4]


CODES = f"{codes_cte('dm', double_metaphone)}, {codes_cte('sxl', _soundex)}, {first_codes_cte('sxf', _soundex)}"
KEYED = f"""{CODES}, keyed as (
    select v.*, dm.code as dm_last, sxl.code as sx_last, sxf.code as sx_first, strftime(dob, '%Y-%m-%d') as dob_text, cast(year(dob) as varchar) as birth_year
    from valid v left join dm on v.last = dm.value left join sxl on v.last = sxl.value left join sxf on v.first = sxf.value
), post as (
    select 'B1' as block, gov_id as key, rec_id as id from keyed
    union all select 'B3', dm_last || '|' || dob_text, rec_id from keyed
    union all select 'B4', last || '|' || birth_year || '|' || substring(first, 1, 3), rec_id from keyed
    union all select 'B5', unnest(phones), rec_id from keyed
    union all select 'B6', email, rec_id from keyed
    union all select 'B7', dm_last || '|' || postal || '|' || birth_year, rec_id from keyed
    union all select 'B8', sx_first || '|' || sx_last || '|' || birth_year, rec_id from keyed
    union all select 'B9', last || '|' || first || '|' || substring(gov_id, 6, 4), rec_id from keyed
), postings as (select * from post where key is not null and key <> ''),
capped as (select block, key, id from (select *, row_number() over (partition by block, key order by id) as n from postings) where n <= 500),
cand as (
    select a.id as id_a, b.id as id_b, list_sort(list(distinct a.block)) as blocks, cast(count(distinct a.block) as integer) as n_blocks
    from capped a join capped b on a.block = b.block and a.key = b.key and a.id < b.id group by all
)"""


def _block(b: str, name: str, title: str) -> None:
    def run(spark, folder):
        """Pairs of one block."""
        return B.candidate_pairs(person(spark, folder), (b,)).select("id_a", "id_b")

    run.__doc__ = title
    query(f"op_{b.lower()}_{name}", with_person(f"select distinct a.id as id_a, b.id as id_b from capped a join capped b on a.block = b.block and a.key = b.key and a.id < b.id where a.block = '{b}'", ctes=KEYED))(run)


for _b, _name, _title in (
    ("B1", "gov_id", "Exact government id."), ("B3", "dm_dob", "Double Metaphone of the last name and date of birth."), ("B4", "last_year_first3", "Last name, birth year, first three letters."),
    ("B5", "any_phone", "Any shared phone."), ("B6", "email", "Exact email."), ("B7", "dm_postal_year", "Double Metaphone, postal code, birth year."),
    ("B8", "soundex_names_year", "Soundex of both names and birth year."), ("B9", "names_last4", "Both names and the last four of the id."),
):
    _block(_b, _name, _title)


@query("op_b10_postings", with_person("select * from postings", ctes=KEYED))
def postings(spark, folder):
    return B.postings(person(spark, folder))


@query("op_b11_cap", with_person("select block, key, id from (select *, row_number() over (partition by block, key order by id) as n from postings) where n <= 5", ctes=KEYED))
def cap(spark, folder):
    return B.cap_keys(B.postings(person(spark, folder)), 5)


@query("op_b11_skip", with_person("select block, key, id from (select *, count(*) over (partition by block, key) as n from postings) where n <= 5", ctes=KEYED))
def skip(spark, folder):
    return B.cap_keys(B.postings(person(spark, folder)), 5, "skip")


@query("op_b13_batch_blocking", with_person("select * from cand", ctes=KEYED))
def batch(spark, folder):
    return B.candidate_pairs(person(spark, folder))


@query("op_b15_union_pairs", with_person("select id_a, id_b, blocks, cast(len(blocks) as integer) as n_blocks from (select id_a, id_b, list_sort(list_filter(blocks, lambda b: b in ('B1', 'B6'))) as blocks from cand) where len(blocks) > 0", ctes=KEYED))
def union(spark, folder):
    p = person(spark, folder)
    return B.union_pairs(B.candidate_pairs(p, ("B1",)), B.candidate_pairs(p, ("B6",)))


@query("op_b18_inference", with_person("""
select q.id as new_id, least(q.id, c.id) as id_a, greatest(q.id, c.id) as id_b, list_sort(list(distinct q.block)) as blocks, cast(count(distinct q.block) as integer) as n_blocks
from (select p.* from postings p join valid v on p.id = v.rec_id where v.entity % 50 = 0) q
join (select block, key, id from (select *, row_number() over (partition by block, key order by id) as n from (select p.* from postings p join valid v on p.id = v.rec_id where v.entity % 50 <> 0)) where n <= 500) c
  on q.block = c.block and q.key = c.key and q.id <> c.id group by all""", ctes=KEYED))
def inference(spark, folder):
    """Every 50th entity's records asked against the index of the others."""
    p = person(spark, folder)
    return B.inference_pairs(p.where("entity % 50 = 0"), B.postings(p.where("entity % 50 <> 0")))


@query("op_b20_loose", with_person("""
select a.id as id_a, b.id as id_b, list_sort(list(distinct a.block)) as blocks, cast(count(distinct a.block) as integer) as n_blocks
from (select * from (select *, count(*) over (partition by block, key) as n from (select 'dob' as block, strftime(dob, '%Y-%m-%d') as key, rec_id as id from valid union all select 'sx', sx_last, rec_id from keyed)) where n <= 700 and key is not null) a
join (select * from (select *, count(*) over (partition by block, key) as n from (select 'dob' as block, strftime(dob, '%Y-%m-%d') as key, rec_id as id from valid union all select 'sx', sx_last, rec_id from keyed)) where n <= 700 and key is not null) b
on a.block = b.block and a.key = b.key and a.id < b.id group by all""", ctes=KEYED))
def loose(spark, folder):
    return B.loose_pairs(person(spark, folder), 700)


@query("op_b23_oracle_pairs", with_person("""
select a.id as id_a, b.id as id_b, list_sort(list(distinct a.block)) as blocks, cast(count(distinct a.block) as integer) as n_blocks
from g a join g b on a.block = b.block and a.key = b.key and a.id < b.id group by all""", ctes="g as (select * from (select *, count(*) over (partition by block, key) as n from (select 'gov_id' as block, gov_id as key, rec_id as id from valid union all select 'email', email, rec_id from valid)) where n <= 2000 and key is not null)"))
def oracle_pairs(spark, folder):
    return B.oracle_pairs(person(spark, folder))


@query("op_b22_first_name_dob", with_person("""
select a.id as id_a, b.id as id_b, list_sort(list(distinct a.block)) as blocks, cast(count(distinct a.block) as integer) as n_blocks
from g a join g b on a.block = b.block and a.key = b.key and a.id < b.id where a.gov_id is null or b.gov_id is null group by all""", ctes=KEYED + """,
g as (select * from (select 'X1' as block, first || '|' || dob_text as key, rec_id as id, gov_id from keyed union all select 'X2', sx_first || '|' || dob_text, rec_id, gov_id from keyed) where key is not null)"""))
def first_name_dob(spark, folder):
    return B.first_name_dob_pairs(person(spark, folder))


@query("op_b24_sorted_neighbourhood", with_person("select least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b from r a join r b on b.rn between a.rn + 1 and a.rn + 9", ctes="r as (select rec_id as id, row_number() over (order by last || first, rec_id) as rn from valid where last || first is not null)"))
def sorted_neighbourhood(spark, folder):
    return B.sorted_neighbourhood(B.valid_records(person(spark, folder)), F.concat("last", "first"), 10)


@query("op_b25_adaptive_neighbourhood", with_person("select least(a.id, b.id) as id_a, greatest(a.id, b.id) as id_b from r a join r b on b.rn between a.rn + 1 and a.rn + greatest(5, least(50, a.n)) - 1", ctes="r as (select *, count(*) over (partition by substring(k, 1, 12)) as n from (select rec_id as id, email as k, row_number() over (order by email, rec_id) as rn from valid where email is not null))"))
def adaptive(spark, folder):
    return B.adaptive_neighbourhood(B.valid_records(person(spark, folder)), F.col("email"), 12)


@query("op_b26_multi_pass", with_person("""
select 'B1' as pass, count(*) filter (where list_contains(blocks, 'B1')) as pairs, count(*) filter (where list_contains(blocks, 'B1')) as added from cand
union all select 'B6', count(*) filter (where list_contains(blocks, 'B6')), count(*) filter (where list_contains(blocks, 'B6') and not list_contains(blocks, 'B1')) from cand
union all select 'B5', count(*) filter (where list_contains(blocks, 'B5')), count(*) filter (where list_contains(blocks, 'B5') and not list_contains(blocks, 'B1') and not list_contains(blocks, 'B6')) from cand""", ctes=KEYED))
def multi_pass(spark, folder):
    p = person(spark, folder)
    return B.multi_pass(*[(b, B.candidate_pairs(p, (b,))) for b in ("B1", "B6", "B5")])


@query("op_b27_minhash_lsh")
def lsh(spark, folder):
    p = B.valid_records(person(spark, folder))
    return B.minhash_lsh_pairs(p.where("entity % 10 = 0"), F.concat_ws(" ", "first", "last", "email"), 0.3)


@query("op_b30_equi_rules", with_person("select a.rec_id as id_a, b.rec_id as id_b from valid a join valid b on a.rec_id < b.rec_id and a.gov_id = b.gov_id union select a.rec_id, b.rec_id from valid a join valid b on a.rec_id < b.rec_id and a.last = b.last and a.dob = b.dob"))
def equi_rules(spark, folder):
    p = B.valid_records(person(spark, folder))
    return B.group_pairs(p, {"id": F.col("gov_id"), "ld": F.when(F.col("last").isNotNull() & F.col("dob").isNotNull(), F.concat_ws("|", "last", F.date_format("dob", "yyyy-MM-dd")))}, 1 << 30).select("id_a", "id_b")


@query("op_b31_phone_values", with_person("select a.rec_id as id_a, b.rec_id as id_b, count(*) as shared from (select rec_id, unnest(phones) as v from valid) a join (select rec_id, unnest(phones) as v from valid) b on a.v = b.v and a.rec_id < b.rec_id group by all"))
def phone_values(spark, folder):
    return B.value_pairs(B.valid_records(person(spark, folder)))


@query("op_b32_block_stats", with_person("select block, count(*) as pairs, cast(sum(case when n_blocks = 1 then 1 else 0 end) as bigint) as only_here from (select unnest(blocks) as block, n_blocks from cand) group by block", ctes=KEYED))
def stats(spark, folder):
    return B.block_stats(B.candidate_counts(person(spark, folder)))


@query("op_b32_histogram", with_person("select n_blocks, count(*) as pairs from cand group by n_blocks", ctes=KEYED))
def histogram(spark, folder):
    return B.block_counts_histogram(B.candidate_pairs(person(spark, folder)))


@query("op_n04_block_overlap", with_person("""
select a.block as block_a, b.block as block_b, count(*) as "both", round(count(*) / cast(any_value(x.n) + any_value(y.n) - count(*) as double), 9) as jaccard
from t a join t b using (id_a, id_b) join s x on x.block = a.block join s y on y.block = b.block group by a.block, b.block""", ctes=KEYED + ", t as (select id_a, id_b, unnest(blocks) as block from cand), s as (select block, count(*) as n from t group by block)"))
def overlap(spark, folder):
    return B.block_overlap(B.candidate_counts(person(spark, folder))).withColumn("jaccard", F.round("jaccard", 9))


@query("op_n06_block_advice", with_person("select *, case when only_here / cast(pairs as double) >= 0.05 then 'keep' when only_here > 0 then 'review' else 'remove' end as advice from (select block, count(*) as pairs, cast(sum(case when n_blocks = 1 then 1 else 0 end) as bigint) as only_here from (select unnest(blocks) as block, n_blocks from cand) group by block)", ctes=KEYED))
def advice(spark, folder):
    return B.block_advice(B.block_stats(B.candidate_pairs(person(spark, folder))))


TRUTH = "truth as (select a.rec_id as id_a, b.rec_id as id_b from valid a join valid b on a.entity = b.entity and a.rec_id < b.rec_id)"


def true_pairs(p):
    v = B.valid_records(p).select("rec_id", "entity")
    return v.withColumnRenamed("rec_id", "id_a").join(v.withColumnRenamed("rec_id", "id_b"), "entity").where("id_a < id_b").select("id_a", "id_b")


@query("op_a38_blocking_metrics", with_person("""
select p.n as pairs, f.n as found, round(f.n / cast(t.n as double), 9) as completeness, round(f.n / cast(p.n as double), 9) as quality, round(1 - p.n / (v.n * (v.n - 1) / 2.0), 9) as reduction
from (select count(*) as n from cand) p, (select count(*) as n from cand join truth using (id_a, id_b)) f, (select count(*) as n from truth) t, (select count(*) as n from valid) v""", ctes=KEYED + ", " + TRUTH))
def metrics(spark, folder):
    p = person(spark, folder)
    m = B.blocking_metrics(B.candidate_pairs(p), true_pairs(p), B.valid_records(p).count())
    return m.withColumns({c: F.round(c, 9) for c in ("completeness", "quality", "reduction")})


GRAMS = """texts as (select rec_id as id, lower(concat_ws(' ', first, last)) as t, strftime(dob, '%Y-%m-%d') as c from valid),
tokens as (select id, ' ' || unnest(list_filter(string_split(t, ' '), lambda x: x <> '')) || ' ' as tok from texts where trim(t) <> ''),
grams as (select id, substring(tok, cast(i as integer), n) as gram from tokens, (values (2), (3), (4)) as s(n), unnest(range(1, greatest(1, length(tok) - n + 1) + 1)) as u(i) where length(tok) >= n),
tf as (select id, gram, count(*) as tf from grams group by all), df as (select gram, count(*) as df from tf group by gram having count(*) >= 2),
raw as (select id, gram, tf * (ln((1 + (select count(*) from texts where trim(t) <> '')) / cast(1 + df as double)) + 1) as w from tf join df using (gram)),
w as (select id, gram, w / sqrt(sum(w * w) over (partition by id)) as w from raw),
wc as materialized (select w.*, c from w join texts using (id) where c is not null),
qg as materialized (select a.id as id_a, b.id as id_b, sum(a.w * b.w) as cosine from wc a join wc b on a.c = b.c and a.gram = b.gram where a.id < b.id group by all having sum(a.w * b.w) >= 0.3)"""


@query("op_b14_qgram", with_person("select id_a, id_b, round(cosine, 6) as cosine from qg", ctes=GRAMS))
def qgram(spark, folder):
    p = B.valid_records(person(spark, folder))
    return Q.qgram_pairs(p).select("id_a", "id_b", F.round("cosine", 6).alias("cosine"))


@query("op_b29_threshold_sweep", with_person("select threshold, cast(sum(case when round(cosine, 9) >= threshold then 1 else 0 end) as bigint) as pairs from qg, (values (0.301), (0.451), (0.551), (0.701)) as g(threshold) group by threshold", ctes=GRAMS))
def sweep(spark, folder):
    pairs = Q.qgram_pairs(B.valid_records(person(spark, folder))).withColumn("cosine", F.round("cosine", 9))
    return Q.threshold_sweep(pairs, [0.301, 0.451, 0.551, 0.701])


@query("op_b28_neighbours")
def neighbours(spark, folder):
    """Global cosine neighbours among the distinct names."""
    p = B.valid_records(person(spark, folder)).where("first is not null").groupBy("first", "last").agg(F.min("rec_id").alias("rec_id"))
    return Q.neighbours(Q.weights(p, Q.name_text()), 0.55, 100)


STACKED = KEYED + ", " + GRAMS + """, stacked as materialized (
    select id_a, id_b, list_sort(list(distinct block)) as blocks, cast(count(distinct block) as integer) as n_blocks
    from (select id_a, id_b, unnest(blocks) as block from cand union all select id_a, id_b, 'QG' from qg) group by id_a, id_b
), sizes as (select block, count(*) as n from (select unnest(blocks) as block from stacked) where block <> 'QG' group by block),
weighted as (
    select s.*, coalesce(x.weight, 0.5) as weight from stacked s
    left join (select id_a, id_b, sum(1 / cast(n as double)) as weight from (select id_a, id_b, unnest(blocks) as block from stacked) join sizes using (block) group by all) x using (id_a, id_b)
), ends as (select id_a as node, * from weighted union all select id_b, * from weighted),
pruned as (select distinct id_a, id_b, blocks from (select *, row_number() over (partition by node order by round(weight, 12) desc, id_a desc, id_b desc) as r from ends) where r <= 10)"""


def stacked_weighted(p):
    """The stacked pairs with their weight, by the plain joins."""
    pairs = materialize(B.union_pairs(B.candidate_pairs(p), Q.qgram_pairs(p)), "stacked")
    return G.arcs_weights(pairs).withColumn("weight", F.round("weight", 12))


def stacked_blocks(p, k=0):
    """The stacked blocks, the counts of their pairs and the weight of each set of blocks; None where an id has several rows or grams are too many."""
    near = None if B.repeats(p) else Q.near_texts(p.select(F.col("rec_id").alias("id"), Q.name_text().alias("t")))
    if near is None:
        return None
    s = B.Stacked(p, near, Q.name_text())
    counts = s.counts(k)
    sizes = counts.where("mask is not null").select(F.explode(s.blocks()).alias("block"), "n").where("block <> 'QG'").groupBy("block").agg(F.sum("n").alias("n"))
    known = {r["mask"]: r["weight"] for r in G.arcs_weights(s.masks(), sizes=sizes).select("mask", F.round("weight", 12).alias("weight")).collect()}  # a row for each set of blocks
    return s, counts, [known.get(m) or 0.0 for m in range(1 << len(s.names))]


@query("op_g01_arcs", with_person("select id_a, id_b, round(weight, 9) as weight from weighted", ctes=STACKED))
def arcs(spark, folder):
    p = B.valid_records(person(spark, folder))
    found = stacked_blocks(p)
    if found is None:
        return stacked_weighted(p).select("id_a", "id_b", F.round("weight", 9).alias("weight"))
    s, _, weights = found
    shown = F.array(*[F.round(F.lit(w), 9) for w in weights])  # constant: a pair looks its weight up
    return s.pairs().select("id_a", "id_b", F.get(shown, F.col("mask")).alias("weight"))


def pruned(spark, folder):
    p = B.valid_records(person(spark, folder))
    found = stacked_blocks(p, G.TOP_K)
    if found is None:
        return G.prune_top_k(stacked_weighted(p)).select("id_a", "id_b", "blocks")
    s, counts, weights = found
    if max(weights[2:]) < G.QGRAM_WEIGHT:
        return s.best(counts, weights, G.QGRAM_WEIGHT, G.TOP_K).select("id_a", "id_b", s.blocks().alias("blocks"))
    pairs = s.pairs().withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("mask")))
    return G.prune_top_k(pairs).select("id_a", "id_b", s.blocks().alias("blocks"))


@query("op_g02_prune", with_person("select id_a, id_b from pruned", ctes=STACKED))
def prune(spark, folder):
    return pruned(spark, folder).select("id_a", "id_b")


@query("op_b16_stacked", with_person("select * from pruned", ctes=STACKED))
def stacked(spark, folder):
    return pruned(spark, folder)


B1B6 = "e as (select id_a, id_b from cand where list_contains(blocks, 'B1') or list_contains(blocks, 'B6'))"


@query("op_j19_two_hop", with_person("""
select distinct least(a.x, b.x) as id_a, greatest(a.x, b.x) as id_b from arms a join arms b on a.bridge = b.bridge and a.x < b.x anti join e on e.id_a = least(a.x, b.x) and e.id_b = greatest(a.x, b.x)""", ctes=KEYED + ", " + B1B6 + """,
arms2 as (select id_a as bridge, id_b as x from e union all select id_b, id_a from e), arms as (select * from arms2 where bridge in (select bridge from arms2 group by bridge having count(*) between 2 and 40))"""))
def two_hop(spark, folder):
    return G.two_hop_pairs(materialize(B.candidate_pairs(person(spark, folder), ("B1", "B6")), "pairs"))


@query("op_a30_degrees", with_person("""
select count(*) as nodes, round(avg(d), 9) as mean, quantile_cont(d, 0.5) as median, quantile_cont(d, 0.99) as p99, max(d) as max, cast(sum(case when d > 50 then 1 else 0 end) as bigint) as hubs
from (select node, count(*) as d from (select id_a as node from cand union all select id_b from cand) group by node)""", ctes=KEYED))
def degree_summary(spark, folder):
    return G.degree_summary(B.candidate_pairs(person(spark, folder))).withColumn("mean", F.round("mean", 9))


def rule_edges(spark, folder):
    return materialize(B.candidate_pairs(person(spark, folder), ("B1", "B6")).select("id_a", "id_b"), "edges")


#: In the fixture, email and id determine the entity: the components of B1 and B6 are the records of an entity that
#: have either, unless none has both.
HAS = """both_in as (select entity, bool_or(gov_id is not null and email is not null) as b from valid group by entity),
has as (select v.*, cast(v.entity as varchar) || case when b then '' when gov_id is not null then 'g' else 'e' end as part from valid v join both_in using (entity) where gov_id is not null or email is not null),
grp as (select part, min(rec_id) as root, count(*) as n from has group by part)"""
LONE = "lone as (select rec_id from valid where gov_id is null and email is null union all select h.rec_id from has h join grp g using (part) where g.n = 1)"


@query("op_g03_components", with_person("select rec_id as id, root as component from has join grp using (part) where n > 1", ctes=HAS))
def components(spark, folder):
    from kinweave.operators.components import connected_components

    return connected_components(rule_edges(spark, folder), "id_a", "id_b").select(F.col("node").alias("id"), "component")


@query("op_g04_clusters", with_person("""
select id, cluster_id from (select h.rec_id as id, g.root from has h join grp g on h.part = g.part where g.n > 1 union all select rec_id, rec_id from lone) join roots using (root)""", ctes=HAS + ", " + LONE + """,
roots as (select root, row_number() over (order by lone, root) - 1 as cluster_id from (select root, 0 as lone from grp where n > 1 union all select rec_id, 1 from lone))"""))
def clusters(spark, folder):
    return G.assign_clusters(B.valid_records(person(spark, folder)), rule_edges(spark, folder))


@query("op_a04_cluster_sizes", with_person("select n as size, count(*) as clusters from (select n from grp where n > 1 union all select 1 from lone) group by n", ctes=HAS + ", " + LONE))
def sizes(spark, folder):
    """The flagship: how many groups of which size the strong identifiers make."""
    c = G.assign_clusters(B.valid_records(person(spark, folder)), rule_edges(spark, folder))
    return c.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


@query("op_g07_merge_paths")
def paths(spark, folder):
    """Shortest chains inside the clusters of every 100th entity."""
    p = B.valid_records(person(spark, folder)).where("entity % 100 = 0")
    edges = materialize(B.candidate_pairs(p, ("B1", "B6")).select("id_a", "id_b"), "edges")
    return G.merge_paths(G.assign_clusters(p, edges), edges)


@query("op_g09_external", with_person("select id_a, id_b from cand join valid a on a.rec_id = id_a join valid b on b.rec_id = id_b where (a.entity = 7) <> (b.entity = 7)", ctes=KEYED))
def external(spark, folder):
    p = B.valid_records(person(spark, folder))
    return G.external_pairs(B.candidate_pairs(p), p.where("entity = 7").select(F.col("rec_id").alias("id"))).select("id_a", "id_b")


@query("op_g10_expand", with_person("select a.rec_id as id_a, b.rec_id as id_b from has a join has b on a.part = b.part and a.rec_id < b.rec_id", ctes=HAS))
def expand(spark, folder):
    return G.expand_components(G.assign_clusters(B.valid_records(person(spark, folder)), rule_edges(spark, folder)))
