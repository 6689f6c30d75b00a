"""Queries of the index, reviewer, file, streaming and data-generation operators, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import phonetic, similarity as S
from kinweave.operators import blocking as B, graph as G, index as X, linkage as L, metrics as M, pairs as P, perturb, rules as R
from kinweave.plans.blocking_queries import KEYED, rule_edges
from kinweave.plans.fixture import person, with_person
from kinweave.plans.registry import query
from kinweave.plans.rule_queries import FACTS, candidates, matched, orders, rounded
from kinweave.sources import files
from kinweave.sources.tables import read_table
from kinweave.storage import materialize, new_path
from kinweave.streaming.incremental import event_counts

# ---- index fixture: entity = customer, records = orders ------------------------------------------------------------

INDEX = """members as materialized (select 'M-' || cast(entity as varchar) as entity_id, rec_id, rec_id = min(rec_id) over (partition by entity) as is_primary from valid),
entities as (select 'M-' || cast(entity as varchar) as entity_id, (entity % 97) / 97.0::double as confidence, cast(2000 + entity % 20 as varchar) as updated from valid group by entity),
records as (select rec_id, first, last, dob, substring(gov_id, 6, 4) as gov_id4 from valid),
candidates as materialized (
    select a.rec_id as id_a, b.rec_id as id_b, case (a.entity + length(b.rec_id) + a.entity % 7) % 3 when 0 then 'reject' when 1 then 'gate_dropped' else 'undecided' end as verdict, (a.entity % 101) / 101.0::double as score, 'run1' as run_id
    from valid a join valid b on a.gov_id = b.gov_id where a.rec_id < b.rec_id
), decisions as (select id_a, id_b, 'same' as decision from candidates where substring(id_a, 9, 1) = '7')"""


def index_tables(spark, folder):
    p = B.valid_records(person(spark, folder))
    members = X.with_primary(p.select(F.concat(F.lit("M-"), "entity").alias("entity_id"), "rec_id"))
    entities = p.select("entity").distinct().select(F.concat(F.lit("M-"), "entity").alias("entity_id"), (F.col("entity") % 97 / 97.0).alias("confidence"), (2000 + F.col("entity") % 20).cast("string").alias("updated"))
    records = p.select("rec_id", "first", "last", "dob", F.substring("gov_id", 6, 4).alias("gov_id4"))
    a = p.where("gov_id is not null").select(F.col("rec_id").alias("id_a"), "gov_id", "entity")
    met = a.join(p.select(F.col("rec_id").alias("id_b"), "gov_id"), "gov_id").where("id_a < id_b")
    kind = (F.col("entity") + F.length("id_b") + F.col("entity") % 7) % 3
    cands = met.select("id_a", "id_b", F.when(kind == 0, "reject").when(kind == 1, "gate_dropped").otherwise("undecided").alias("verdict"), (F.col("entity") % 101 / 101.0).alias("score"), F.lit("run1").alias("run_id"))
    decisions = cands.where(F.substring("id_a", 9, 1) == "7").select("id_a", "id_b", F.lit("same").alias("decision"))
    return members, entities, records, cands, decisions


@query("op_x12_list_entities", with_person("""
select entity_id, confidence, updated, n_members, first, last from (
    select e.*, (select count(*) from members m where m.entity_id = e.entity_id) as n_members, r.first, r.last
    from entities e left join members m on m.entity_id = e.entity_id and m.is_primary left join records r using (rec_id)) order by confidence desc nulls last, entity_id limit 50 offset 50""", ctes=INDEX))
def list_entities(spark, folder):
    m, e, r, _, _ = index_tables(spark, folder)
    return X.list_entities(e, m, r, sort="confidence", page=1)


@query("op_p08_search", with_person("select distinct entity_id from members join records using (rec_id) where contains(lower(concat_ws(' ', rec_id, first, last, strftime(dob, '%Y-%m-%d'), gov_id4)), 'oakley') and contains(lower(concat_ws(' ', rec_id, first, last, strftime(dob, '%Y-%m-%d'), gov_id4)), '19')", ctes=INDEX))
def search(spark, folder):
    m, e, r, _, _ = index_tables(spark, folder)
    return X.search_entities(m, r, "Oakley 19")


QUEUE = INDEX + """, queue as (select c.*, a.entity_id as entity_a, b.entity_id as entity_b, d.decision, case when d.decision is not null then 'reviewed' when a.entity_id = b.entity_id then 'auto_merged' when verdict in ('reject', 'gate_dropped') then 'auto_rejected' else 'needs_review' end as bucket
    from candidates c join members a on a.rec_id = c.id_a join members b on b.rec_id = c.id_b left join decisions d on d.id_a = c.id_a and d.id_b = c.id_b)"""


@query("op_j10_review_queue", with_person("select id_a, id_b, verdict, round(score, 9) as score, entity_a, entity_b, bucket from queue where score >= 0.25 and score < 0.75", ctes=QUEUE))
def queue(spark, folder):
    m, e, r, c, d = index_tables(spark, folder)
    return rounded(X.review_queue(c, m, d, low=0.25, high=0.75), "score").select("id_a", "id_b", "verdict", "score", "entity_a", "entity_b", "bucket")


@query("op_a26_bucket_counts", with_person("select bucket, count(*) as n from queue group by bucket", ctes=QUEUE))
def bucket_counts(spark, folder):
    m, e, r, c, d = index_tables(spark, folder)
    return X.bucket_counts(X.review_queue(c, m, d))


@query("op_a25_dashboard", with_person("select (select count(*) from entities) as entities, (select count(*) from members) as records, (select count(*) from (select entity_id from members group by entity_id having count(*) > 1)) as multi, (select count(*) from queue where bucket = 'needs_review') as pending", ctes=QUEUE))
def dashboard(spark, folder):
    m, e, r, c, d = index_tables(spark, folder)
    return X.dashboard(e, m, X.review_queue(c, m, d))


@query("op_x03_upsert", "select o_orderkey, case when o_orderkey % 4 = 0 then -1 else o_custkey end as v from orders where o_orderkey % 2 = 0 or o_orderkey % 4 = 0")
def upsert(spark, folder):
    o = orders(spark, folder).select("o_orderkey", F.col("o_custkey").cast("long").alias("v"))
    return X.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 4 = 0").withColumn("v", F.lit(-1).cast("long")), ["o_orderkey"])


@query("op_x05_insert_ignore", "select o_orderkey, case when o_orderkey % 2 = 0 then o_custkey else -1 end as v from orders where o_orderkey % 2 = 0 or o_orderkey % 3 = 0")
def insert_ignore(spark, folder):
    o = orders(spark, folder).select("o_orderkey", F.col("o_custkey").cast("long").alias("v"))
    return X.insert_ignore(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0").withColumn("v", F.lit(-1).cast("long")), ["o_orderkey"])


AUDIT = "audit as (select o_orderkey as audit_id, case o_orderkey % 4 when 0 then 'merge' when 1 then 'unmerge' when 2 then 'dismiss' else 'undo' end as action, ['R' || cast(o_custkey % 20 as varchar), 'R' || cast(20 + o_orderkey % 30 as varchar)] as rec_ids, case when o_orderkey % 4 = 3 then o_orderkey - 3 end as undo_of, lpad(cast(o_orderkey as varchar), 9, '0') as created from orders)"


def audit(spark, folder):
    k = F.col("o_orderkey")
    action = F.element_at(F.array(*[F.lit(a) for a in ("merge", "unmerge", "dismiss", "undo")]), (k % 4).cast("int") + 1)
    return orders(spark, folder).select(
        k.alias("audit_id"), action.alias("action"), F.array(F.concat(F.lit("R"), F.col("o_custkey") % 20), F.concat(F.lit("R"), 20 + k % 30)).alias("rec_ids"), F.when(k % 4 == 3, k - 3).alias("undo_of"), F.lpad(k.cast("string"), 9, "0").alias("created")
    )


@query("op_x08_locked", f"with {AUDIT} select distinct unnest(rec_ids) as rec_id from audit a where action in ('merge', 'unmerge') and not exists (select 1 from audit u where u.undo_of = a.audit_id)")
def locked(spark, folder):
    return X.locked_records(audit(spark, folder))


@query("op_w11_audit_feed", f"with {AUDIT} select audit_id, action, created, exists (select 1 from audit u where u.undo_of = a.audit_id) as undone from audit a where created >= '000000100' order by created desc, audit_id desc limit 50")
def audit_feed(spark, folder):
    return X.audit_feed(audit(spark, folder), "000000100").drop("rec_ids", "undo_of")


@query("op_a27_action_counts", f"with {AUDIT} select action, count(*) as n from audit group by action")
def action_counts(spark, folder):
    return X.action_counts(audit(spark, folder))


@query("op_io20_reviewer_labels", f"with {AUDIT} select least(rec_ids[1], rec_ids[2]) as id_a, greatest(rec_ids[1], rec_ids[2]) as id_b, max_by(action = 'merge', created) as label from audit a where action in ('merge', 'unmerge') and not exists (select 1 from audit u where u.undo_of = a.audit_id) group by all")
def reviewer_labels(spark, folder):
    return X.labelled_pairs(audit(spark, folder))


@query("op_x01_reconcile")
def reconcile(spark, folder):
    """Clusters by strong identifiers against an index in which every second customer has an entity."""
    p = B.valid_records(person(spark, folder))
    clusters = materialize(G.assign_clusters(p, rule_edges(spark, folder)), "clusters")
    members = p.where("entity % 2 = 0").select(F.concat(F.lit("M-"), "entity").alias("entity_id"), "rec_id")
    return X.reconcile(clusters, members, p.where("entity = 10").select("rec_id"))[0]


@query("op_x09_score_batch")
def score_batch(spark, folder):
    """Every tenth customer's later records arrive at an index of all others."""
    p = B.valid_records(person(spark, folder))
    late = (F.col("entity") % 10 == 0) & (F.pmod(F.xxhash64("rec_id"), F.lit(2)) == 0)
    old, new = p.where(~late), p.where(late)
    members = old.select(F.concat(F.lit("M-"), "entity").alias("entity_id"), "rec_id")
    return X.score_batch(new, old, members, materialize(B.postings(old), "postings"))[0]


@query("op_x11_bridge", with_person("""
select rec_id, 'M-' || lpad(cast(entity // 2 * 2 as varchar), 6, '0') as entity_id from valid where (entity // 2 * 2) in (select entity from valid) and (entity // 2 * 2 + 1) in (select entity from valid)"""))
def bridge(spark, folder):
    """An edge joins each odd customer's first record to the even customer's before it."""
    p = B.valid_records(person(spark, folder))
    members = p.select(F.concat(F.lit("M-"), F.lpad(F.col("entity").cast("string"), 6, "0")).alias("entity_id"), "rec_id", "entity")
    first = p.groupBy("entity").agg(F.min("rec_id").alias("r"))
    a, b = first.where("entity % 2 = 0").select(F.col("entity").alias("k"), F.col("r").alias("id_a")), first.where("entity % 2 = 1").select((F.col("entity") - 1).alias("k"), F.col("r").alias("id_b"))
    both = a.join(b, "k")
    pairs = members.join(both.select("k"), F.expr("entity div 2 * 2") == both["k"], "left_semi")
    return X.bridge(pairs.select("entity_id", "rec_id"), both.select("id_a", "id_b")).select("rec_id", "entity_id")


@query("op_x06_hashed_postings", with_person("select block, case when block in ('B1', 'B6') then sha256(key) else key end as key, id from postings", ctes=KEYED))
def hashed(spark, folder):
    return B.hashed_postings(B.postings(person(spark, folder)))


@query("op_g08_pair_trace", with_person("select a.rec_id as id_a, b.rec_id as id_b, coalesce(len(f.rules_fired) > 0, false) as matched, f.id_a is not null as candidate from valid a join valid b on a.entity = 7 and b.entity = 7 and a.rec_id < b.rec_id left join fired f on f.id_a = a.rec_id and f.id_b = b.rec_id", ctes=FACTS))
def pair_trace(spark, folder):
    p, c, m = matched(spark, folder)
    return X.pair_trace(p.where("entity = 7").select(F.col("rec_id").alias("id")), matched=m, candidate=c)


# ---- verdicts, queues, display ------------------------------------------------------------------------------------

FLAGS = "select o_orderkey, o_orderkey % 5 = 0 as m, o_orderkey % 7 = 0 as r, case o_orderkey % 3 when 0 then 'auto_merge' when 1 then 'human_review' end as ml, case o_custkey % 3 when 0 then 'no_match' when 1 then 'human_review' end as gate, o_custkey % 2 = 0 as same, case when o_custkey % 11 = 0 then 'same' end as d from orders"


def flags(spark, folder):
    return orders(spark, folder).selectExpr(*FLAGS.removeprefix("select ").removesuffix(" from orders").split(", "))


@query("op_r08_verdict", f"select o_orderkey, case when m then 'auto_merge_rule' when r then 'reject' when ml = 'auto_merge' then 'ml_auto_merge' when ml is not null then 'ml_human_review' when gate = 'no_match' then 'gate_dropped' else 'undecided' end as verdict from ({FLAGS})")
def verdict(spark, folder):
    return flags(spark, folder).select("o_orderkey", R.pair_verdict(F.col("m"), F.col("r"), F.col("ml"), F.col("gate")).alias("verdict"))


@query("op_r09_bucket", f"select o_orderkey, case when d is not null then 'reviewed' when same then 'auto_merged' when gate in ('reject', 'gate_dropped') then 'auto_rejected' else 'needs_review' end as bucket from ({FLAGS})")
def bucket(spark, folder):
    return flags(spark, folder).select("o_orderkey", R.queue_bucket(F.col("d"), F.col("same"), F.col("gate")).alias("bucket"))


@query("op_r10_routes", f"select o_orderkey, case when same then 'human_review' when m then 'auto_merge' else 'no_match' end as expected, case when m then 'auto_merge' when not same or r then 'no_match' else 'human_review' end as system from ({FLAGS})")
def routes(spark, folder):
    return flags(spark, folder).select("o_orderkey", R.expected_route(F.col("m"), F.col("same")).alias("expected"), R.system_route(F.col("m"), F.col("same"), F.col("r")).alias("system"))


@query("op_s24_agreement", with_person("select id_a, id_b, case when g_l is null and g_r is null then 'both_missing' when g_l is null or g_r is null then 'one_missing' when g_l = g_r then 'equal' else 'differ' end as gov_id, case when len(list_intersect(p_l, p_r)) > 0 then 'equal' else 'differ' end as phones from both_sides", ctes=FACTS))
def agreement(spark, folder):
    p, c = candidates(spark, folder)
    both = P.attach(c, p, ["gov_id", "phones"])
    return both.select("id_a", "id_b", S.agreement(F.col("gov_id_l"), F.col("gov_id_r")).alias("gov_id"), S.set_agreement(F.col("phones_l"), F.col("phones_r")).alias("phones"))


@query("op_s21_display", with_person("select id_a, id_b, case when f_l is null or f_r is null then 'missing' when lower(f_l) = lower(f_r) then 'exact' else 'different' end as first, case when len(p_l) = 0 or len(p_r) = 0 then 'missing' when list_sort(list_distinct(p_l)) = list_sort(list_distinct(p_r)) then 'exact' when list_has_any(p_l, p_r) then 'partial' else 'different' end as phones from both_sides", ctes=FACTS))
def display(spark, folder):
    p, c = candidates(spark, folder)
    both = P.attach(c, p, ["first", "phones"])
    return both.select("id_a", "id_b", S.display_status(F.col("first_l"), F.col("first_r")).alias("first"), S.display_sets(F.col("phones_l"), F.col("phones_r")).alias("phones"))


@query("op_s08_token_jaccard", with_person("select id_a, id_b, round(len(list_intersect([f_l, n_l], [f_r, n_r])) / cast(len(list_distinct([f_l, n_l] || [f_r, n_r])) as double), 9) as j from both_sides where f_l is not null and f_r is not null", ctes=FACTS))
def token_jaccard(spark, folder):
    p, c = candidates(spark, folder)
    both = P.attach(c, p, ["first", "last"]).where("first_l is not null and first_r is not null")
    return both.select("id_a", "id_b", F.round(S.token_jaccard(F.array("first_l", "last_l"), F.array("first_r", "last_r")), 9).alias("j"))


@query("op_s14_dob_similarity", with_person("select id_a, id_b, round(1 - levenshtein(strftime(dob_l, '%Y%m%d'), strftime(dob_r, '%Y%m%d')) / 8.0, 9)::double as sim from both_sides", ctes=FACTS))
def dob_similarity(spark, folder):
    p, c = candidates(spark, folder)
    return P.attach(c, p, ["dob"]).select("id_a", "id_b", F.round(S.date_similarity(F.col("dob_l"), F.col("dob_r")), 9).alias("sim"))


@query("op_s01_soundex", with_person("select distinct v.last, sxl.code as code from valid v join sxl on v.last = sxl.value", ctes=KEYED))
def soundex(spark, folder):
    return B.valid_records(person(spark, folder)).select("last").distinct().withColumn("code", phonetic.soundex(F.col("last")))


@query("op_s02_double_metaphone")
def double_metaphone(spark, folder):
    return phonetic.with_code(person(spark, folder).select("last").distinct(), "last", "code")


@query("op_s03_metaphone")
def metaphone(spark, folder):
    return phonetic.with_code(person(spark, folder).select("last").distinct(), "last", "code", phonetic.metaphone_udf)


@query("op_p01_validity", with_person("select rec_id from valid"))
def validity(spark, folder):
    return B.valid_records(person(spark, folder)).select("rec_id")


@query("op_p07_tiers", "select o_orderkey, case when p >= 0.95 then 'auto_merge' when p >= 0.4 then 'human_review' else 'no_match' end as fs, case when p >= 0.7 then 'auto_merge' else 'human_review' end as ml, case when p >= 0.3 then 'human_review' else 'no_match' end as gate from (select o_orderkey, (o_custkey % 101) / 100.0::double as p from orders)")
def tiers(spark, folder):
    p = F.col("o_custkey") % 101 / 100.0
    return orders(spark, folder).select("o_orderkey", L.fs_tier(p).alias("fs"), L.ml_tier(p).alias("ml"), L.gate_tier(p).alias("gate"))


# ---- files --------------------------------------------------------------------------------------------------------


@query("op_io01_csv_strings", "select lpad(cast(n_nationkey as varchar), 4, '0') as n_nationkey, n_name from nation")
def csv_strings(spark, folder):
    path = new_path(spark, "csv")
    read_table(spark, folder, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 4, "0").alias("n_nationkey"), "n_name").write.option("header", True).csv(path)
    return files.read_csv_strings(spark, path)


@query("op_io06_json_records", "select cast(r_regionkey as varchar) as r_regionkey, r_name from region")
def json_records(spark, folder):
    path = new_path(spark, "json")
    read_table(spark, folder, "region").select("r_regionkey", "r_name").write.json(path)
    return spark.read.option("primitivesAsString", True).json(path).select("r_regionkey", "r_name")


@query("op_io08_versioned", "select n_nationkey, n_name from nation")
def versioned(spark, folder):
    base = new_path(spark, "versions")
    df = read_table(spark, folder, "nation").select("n_nationkey", "n_name")
    files.write_versioned(df.limit(1), base, "nation", "2026-01-01", "n_nationkey")
    files.write_versioned(df, base, "nation", "2026-01-02", "n_nationkey")
    return spark.read.parquet(files.latest_version(spark, base, "nation"))


@query("op_io11_manifest", "select 'nation' as artifact, (select count(*) from nation) as rows union all select 'region', count(*) from region")
def manifest(spark, folder):
    base = new_path(spark, "runs")
    made = files.write_run(base, "r1", {t: read_table(spark, folder, t) for t in ("nation", "region")})
    again = files.read_manifest(spark, base, files.newest_run_with(spark, base, "region"))
    assert made == again
    return spark.createDataFrame([(n, a["rows"]) for n, a in again["artifacts"].items()], "artifact string, rows long")


@query("op_io04_pushdown", with_person("select id_a, id_b from cand where id_a in ('R00000007', 'R00000012', 'R00000100') or id_b in ('R00000007', 'R00000012', 'R00000100')", ctes=KEYED))
def pushdown(spark, folder):
    """Pairs that touch some records, read back from sorted files with pushed filters."""
    pairs = materialize(B.candidate_pairs(person(spark, folder)).select("id_a", "id_b").sort("id_a", "id_b"), "pairs")
    return P.either_side(pairs, ["R00000007", "R00000012", "R00000100"])


# ---- streams ------------------------------------------------------------------------------------------------------


@query("op_stream_event_counts", "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def stream_counts(spark, folder):
    """Events read as a stream, windowed behind a watermark, every batch merged into a table."""
    schema = read_table(spark, folder, "events").schema
    out, check = new_path(spark, "stream-out"), new_path(spark, "stream-check")
    stream = spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/events.parquet*")
    counts = event_counts(stream)

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "total"), F.col("batch")).alias("v"))
    return last.select("start", "event_type", "v.n", F.round("v.total", 6).alias("total"))


# ---- perturbations and generators ---------------------------------------------------------------------------------


@query("op_n01_perturb", with_person("""
select rec_id, 'swap_month_day' as scenario, strftime(make_date(year(dob), day(dob), month(dob)), '%Y-%m-%d') as value from valid where day(dob) <= 12 and day(dob) <> month(dob)
union all select rec_id, 'truncate_last', substring(last, 1, length(last) - 1) from valid where length(last) > 3
union all select rec_id, 'january_first', cast(year(dob) as varchar) || '-01-01' from valid where strftime(dob, '%m-%d') <> '01-01'"""))
def perturbed(spark, folder):
    p = B.valid_records(person(spark, folder))
    return perturb.scenarios(p, ("swap_month_day", "truncate_last", "january_first"))


@query("op_n02_scenario_recall")
def scenario_recall(spark, folder):
    p = B.valid_records(person(spark, folder))
    return perturb.blocking_recall(p)


@query("op_io19_generator")
def generator(spark, folder):
    """Messy raw records with planted duplicates, as many as there are customers."""
    return perturb.generate_raw(spark, read_table(spark, folder, "customer").count(), 0.2, 42)


@query("op_n03_marginal", with_person("select blocks[1] as block, count(*) as pairs from cand where n_blocks = 1 group by all", ctes=KEYED))
def marginal(spark, folder):
    counts = B.candidate_counts(person(spark, folder))
    return counts.where("n_blocks = 1").groupBy(F.element_at("blocks", 1).alias("block")).agg(F.sum("pairs").alias("pairs"))


@query("op_n14_rebuild_records", with_person("select distinct rec_id, last from (select id_a as rec_id, n_l as last from both_sides union all select id_b, n_r from both_sides)", ctes=FACTS))
def rebuild(spark, folder):
    p, c = candidates(spark, folder)
    both = P.attach(c, p, ["last"])
    return both.select(F.col("id_a").alias("rec_id"), F.col("last_l").alias("last")).unionByName(both.select(F.col("id_b").alias("rec_id"), F.col("last_r").alias("last"))).dropDuplicates(["rec_id"])


@query("op_p12_holdout", with_person("select id_a, id_b from both_sides where cast(('0x' || substring(sha256(id_a || '|' || id_b || '|holdout'), 1, 8)) as bigint) / 4294967296.0 < 0.2", ctes=FACTS))
def holdout(spark, folder):
    p, c = candidates(spark, folder)
    return c.where(S.pair_bucket(F.col("id_a"), F.col("id_b"), "holdout") < 0.2)


@query("op_a41_recall_by_block", with_person("select block, count(*) as hits from (select unnest(c.blocks) as block from cand c join valid a on a.rec_id = c.id_a join valid b on b.rec_id = c.id_b where a.entity = b.entity) group by block", ctes=KEYED))
def recall_by_block(spark, folder):
    p = B.valid_records(person(spark, folder))
    both = P.attach(B.candidate_pairs(p), p, ["entity"]).where("entity_l = entity_r")
    return both.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("hits"))


@query("op_a46_recall_by_case", with_person("select case when f_l <> f_r then 'first' when n_l <> n_r then 'last' when dob_l <> dob_r then 'dob' else 'none' end as kind, count(*) as pairs, round(avg(case when len(rules_fired) > 0 then 1.0 else 0 end), 9) as recall from fired where label group by all", ctes=FACTS))
def recall_by_case(spark, folder):
    p, c, m = matched(spark, folder)
    both = P.attach(P.with_flags(c, merged=m), p, ["first", "last", "dob", "entity"]).where("entity_l = entity_r")
    kind = F.when(R.differ("first"), "first").when(R.differ("last"), "last").when(R.differ("dob"), "dob").otherwise("none")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("merged").cast("int")), 9).alias("recall"))


@query("op_a36_architectures", with_person("select 'rules' as system, count(*) filter (where label and len(rules_fired) > 0) as tp, count(*) filter (where not label and len(rules_fired) > 0) as fp from fired union all select 'no_veto', count(*) filter (where label and n_contradictions < 3), count(*) filter (where not label and n_contradictions < 3) from fired", ctes=FACTS))
def architectures(spark, folder):
    p, c, m = matched(spark, folder)
    both = P.attach(P.with_flags(c, merged=m), p, ["first", "last", "dob", "gov_id", "entity"])
    label, veto = F.col("entity_l") == F.col("entity_r"), R.contradictions() >= 3
    row = lambda name, keep: both.agg(F.lit(name).alias("system"), M.n_if(label & keep).alias("tp"), M.n_if(~label & keep).alias("fp"))
    return row("rules", F.col("merged")).unionByName(row("no_veto", ~veto))


