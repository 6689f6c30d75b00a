"""The resolved index: entities, members, postings, candidates and reviewer decisions as tables.

Every operation is a pure function from tables to tables.  ``IndexStore`` keeps
them as Parquet and swaps a whole table at once: the new version is written
beside the old one, then a pointer file names it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kinweave.operators.components import connected_components
from kinweave.operators.pairs import canonical
from kinweave.operators.rules import queue_bucket

TABLES = {
    "entities": "entity_id string, confidence double, updated string",
    "members": "entity_id string, rec_id string, is_primary boolean",
    "records": "rec_id string, first string, last string, dob date, gov_id4 string",
    "postings": "block string, key string, id string",
    "candidates": "id_a string, id_b string, verdict string, score double, run_id string",
    "decisions": "id_a string, id_b string, decision string, audit_id long, seq long",
    "audit": "audit_id long, action string, entity_ids array<string>, rec_ids array<string>, undo_of long, created string",
}


class IndexStore:
    """Tables below a folder; readers see the last committed version of all of them together.

    One small file names the version of every table.  It is replaced as a
    whole, so readers see all tables of a commit or none.  ``rollback`` goes
    back a commit; ``clean`` removes the versions no commit kept names.
    """

    POINTER = "_current.json"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _history(self) -> list[dict[str, str]]:
        """Versions by table of every commit, the last one first."""
        from kinweave.sources.files import listing

        if self.POINTER not in listing(self.spark, self.folder):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.POINTER}")
        stream = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, history: list[dict[str, str]]) -> None:
        """Write the pointer beside the old one and rename it over it."""
        from kinweave.sources.files import put_text

        put_text(self.spark, f"{self.folder}/{self.POINTER}.new", json.dumps(history))
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        new, old = (jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.POINTER}{x}") for x in (".new", ""))
        rename = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, old, rename)

    def read(self, name: str) -> DataFrame:
        version = next(iter(self._history()), {}).get(name)
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}/{version}")

    def commit(self, keep: int = 10, **tables: DataFrame) -> None:
        """Writes new versions of the tables, then moves the one pointer; ``keep`` commits stay in the history."""
        history = self._history()
        versions = {n: f"v-{uuid.uuid4().hex}" for n in tables}
        for name, df in tables.items():
            columns = [c.split()[0] for c in TABLES[name].split(", ")]
            df.select(*columns).write.parquet(f"{self.folder}/{name}/{versions[name]}")
        self._point([next(iter(history), {}) | versions, *history][:keep])

    def rollback(self) -> bool:
        """Go back to the commit before the last; false if there is none."""
        history = self._history()
        if len(history) < 2:
            return False
        self._point(history[1:])
        return True

    def clean(self) -> int:
        """Remove table versions that no commit of the history names, such as those of a commit that failed; returns how many."""
        from kinweave.sources.files import listing

        named = {(t, v) for h in self._history() for t, v in h.items()}
        jvm, removed = self.spark.sparkContext._jvm, 0
        for table in TABLES:
            for version in listing(self.spark, f"{self.folder}/{table}"):
                if version.startswith("v-") and (table, version) not in named:
                    path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/{version}")
                    path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
                    removed += 1
        return removed


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not there yet are added."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replace_run(old: DataFrame, new: DataFrame, run_id: str) -> DataFrame:
    return old.where(F.col("run_id") != run_id).unionByName(new)


def locked_records(audit: DataFrame) -> DataFrame:
    """(rec_id) of records that reviewers have merged or split, in actions not undone."""
    undone = audit.where("undo_of is not null").select(F.col("undo_of").alias("audit_id"))
    return audit.where("action in ('merge', 'unmerge')").join(undone, "audit_id", "left_anti").select(F.explode("rec_ids").alias("rec_id")).distinct()


def audit_feed(audit: DataFrame, since: str | None = None, n: int = 50) -> DataFrame:
    """The newest actions with ``undone``."""
    undone = audit.where("undo_of is not null").select(F.col("undo_of").alias("u")).distinct()
    rows = audit.join(undone, F.col("audit_id") == F.col("u"), "left").withColumn("undone", F.col("u").isNotNull()).drop("u")
    rows = rows.where(F.col("created") >= since) if since else rows
    return rows.orderBy(F.col("created").desc(), F.col("audit_id").desc()).limit(n)


def action_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def reconcile(clusters: DataFrame, members: DataFrame, locked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, suggestions): entities for a run's clusters (id, cluster_id).

    A cluster takes the least entity id among its records' present ones; of
    several clusters that would take the same id, the one with the least record
    keeps it and the others get new ids, so that splitting an entity does not
    merge it again.  Locked records keep their entity, and a cluster that holds
    one only gives suggestions (rec_id, entity_id).  Entities without members
    disappear.
    """
    from kinweave.operators.ranking import global_rank

    held = clusters.join(locked.select(F.col("rec_id").alias("id")), "id", "left_semi").select("cluster_id").distinct()
    known = clusters.join(members.select(F.col("rec_id").alias("id"), "entity_id"), "id", "left")
    per = known.groupBy("cluster_id").agg(F.min("entity_id").alias("entity_id"), F.min("id").alias("least"))
    free = per.join(held, "cluster_id", "left_anti")
    claim = F.row_number().over(Window.partitionBy("entity_id").orderBy("least"))
    claimed = free.withColumn("entity_id", F.when(F.col("entity_id").isNotNull() & (claim == 1), F.col("entity_id")))
    top = members.agg(F.coalesce(F.max(F.expr("try_cast(substring(entity_id, 3) as bigint)")), F.lit(0)).alias("top")).first()["top"]
    fresh = global_rank(claimed.where("entity_id is null").select("cluster_id", "least"), ["least", "cluster_id"], "rank")
    new_ids = fresh.select("cluster_id", F.concat(F.lit("M-"), (F.col("rank") + F.lit(top)).cast("string")).alias("entity_id"))
    named = claimed.where("entity_id is not null").select("cluster_id", "entity_id").unionByName(new_ids)
    assigned = clusters.join(named, "cluster_id").select("entity_id", F.col("id").alias("rec_id"))
    rest = members.join(assigned.select("rec_id"), "rec_id", "left_anti").select("entity_id", "rec_id")
    out = with_primary(assigned.unionByName(rest))
    suggested = clusters.join(held, "cluster_id", "left_semi").join(per.select("cluster_id", "entity_id"), "cluster_id").select(F.col("id").alias("rec_id"), "entity_id")
    return out, suggested


def with_primary(members: DataFrame) -> DataFrame:
    """Marks the least record of every entity as its primary one."""
    first = F.min("rec_id").over(Window.partitionBy("entity_id"))
    return members.select("entity_id", "rec_id", (F.col("rec_id") == first).alias("is_primary"))


def merge_entities(members: DataFrame, into: str, others: list[str]) -> DataFrame:
    moved = members.withColumn("entity_id", F.when(F.col("entity_id").isin(others), F.lit(into)).otherwise(F.col("entity_id")))
    return with_primary(moved.select("entity_id", "rec_id"))


def unmerge_records(members: DataFrame, entity: str, records: list[str], new_entity: str) -> DataFrame:
    out = F.when((F.col("entity_id") == entity) & F.col("rec_id").isin(records), F.lit(new_entity)).otherwise(F.col("entity_id"))
    return with_primary(members.withColumn("entity_id", out).select("entity_id", "rec_id"))


def decide(decisions: DataFrame, spark: SparkSession, records: list[str], decision: str, audit_id: int, seq: int) -> DataFrame:
    """A reviewer's decision on all pairs of some records; the last write of a pair wins."""
    ids = sorted(set(records))
    rows = [(a, b, decision, audit_id, seq) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    return upsert(decisions, spark.createDataFrame(rows, TABLES["decisions"]), ["id_a", "id_b"])


def retract(decisions: DataFrame, audit_id: int) -> DataFrame:
    return decisions.where(F.col("audit_id") != audit_id)


def labelled_pairs(audit: DataFrame) -> DataFrame:
    """(id_a, id_b, label) from merge and unmerge actions not undone; the last action on a pair wins."""
    undone = audit.where("undo_of is not null").select(F.col("undo_of").alias("audit_id"))
    acts = audit.where("action in ('merge', 'unmerge')").join(undone, "audit_id", "left_anti")
    a = acts.select("audit_id", "created", "action", F.explode("rec_ids").alias("a"), "rec_ids")
    pairs = a.select("audit_id", "created", "action", "a", F.explode("rec_ids").alias("b")).where("a < b")
    return pairs.groupBy(F.col("a").alias("id_a"), F.col("b").alias("id_b")).agg(F.max_by(F.col("action") == "merge", F.struct("created", "audit_id")).alias("label"))


def search_entities(members: DataFrame, records: DataFrame, words: str) -> DataFrame:
    """(entity_id): every word is found in some name or id column of one and the same member."""
    fields = F.lower(F.concat_ws(" ", "rec_id", "first", "last", F.date_format("dob", "yyyy-MM-dd"), "gov_id4"))
    hit = F.lit(True)
    for w in words.lower().split():
        hit = hit & fields.contains(w)
    return members.join(records.where(hit).select("rec_id"), "rec_id", "left_semi").select("entity_id").distinct()


def list_entities(entities: DataFrame, members: DataFrame, records: DataFrame, words: str = "", sort: str = "updated", page: int = 0, size: int = 50) -> DataFrame:
    """A page of (entity_id, confidence, updated, n_members, first, last), the names of the primary record."""
    base = entities.join(search_entities(members, records, words), "entity_id", "left_semi") if words.strip() else entities
    counts = members.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_members"))
    primary = members.where("is_primary").join(records, "rec_id").select("entity_id", "first", "last")
    rows = base.join(counts, "entity_id", "left").join(primary, "entity_id", "left").na.fill(0, ["n_members"])
    order = {"updated": [F.col("updated").desc_nulls_last()], "confidence": [F.col("confidence").desc_nulls_last()], "name": [F.lower("last").asc_nulls_last(), F.lower("first").asc_nulls_last()]}[sort]
    return rows.orderBy(*order, "entity_id").offset(page * size).limit(size)


def get_entity(members: DataFrame, records: DataFrame, entity: str) -> DataFrame:
    return members.where(F.col("entity_id") == entity).join(records, "rec_id")


def review_queue(candidates: DataFrame, members: DataFrame, decisions: DataFrame, bucket: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """The latest candidate row of each pair with both entities and its bucket, best scores first."""
    last = Window.partitionBy("id_a", "id_b").orderBy(F.col("run_id").desc(), F.col("verdict"))
    rows = candidates.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    a, b = (members.select(F.col("rec_id").alias(f"id_{s}"), F.col("entity_id").alias(f"entity_{s}")) for s in "ab")
    rows = rows.join(a, "id_a").join(b, "id_b").join(decisions.select("id_a", "id_b", "decision"), ["id_a", "id_b"], "left")
    rows = rows.withColumn("bucket", queue_bucket(F.col("decision"), F.col("entity_a") == F.col("entity_b"), F.col("verdict")))
    if bucket:
        rows = rows.where(F.col("bucket") == bucket)
    if low is not None:
        rows = rows.where(F.col("score") >= low)
    if high is not None:
        rows = rows.where(F.col("score") < high)
    return rows.orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "id_a", "id_b")


def bucket_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def bridge(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(rec_id, entity_id) after new edges: entities joined by them are one, with the least entity id of the component.

    Records without an entity that no edge reaches are not in the result.
    """
    own = members.select(F.col("rec_id").alias("a"), F.concat(F.lit("\u0000"), "entity_id").alias("b"))
    parts = connected_components(edges.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).unionByName(own), "a", "b")
    names = parts.where(F.col("node").startswith("\u0000")).groupBy("component").agg(F.min(F.expr("substring(node, 2)")).alias("entity_id"))
    return parts.where(~F.col("node").startswith("\u0000")).join(names, "component", "left").select(F.col("node").alias("rec_id"), "entity_id", "component")


def score_batch(new: DataFrame, records: DataFrame, members: DataFrame, index: DataFrame, rules=None) -> tuple[DataFrame, DataFrame]:
    """Incremental scoring of a batch of new cleaned records against the index.

    Returns (members, postings) after it: new records block against the index
    and each other, rules make edges, edges bridge entities, and records that
    nothing links become entities named after themselves.  The partition is
    that of scoring the records one by one in any order.
    """
    from kinweave.operators.blocking import cap_keys, inference_pairs, pairs_within_keys, postings
    from kinweave.operators.rules import RULES, apply_rules

    own = postings(new)
    pairs = inference_pairs(new, index).select("id_a", "id_b").unionByName(pairs_within_keys(cap_keys(own)).select("id_a", "id_b")).distinct()
    both = records.unionByName(new, allowMissingColumns=True)
    edges = apply_rules(pairs, both, rules or RULES).select("id_a", "id_b")
    joined = bridge(members, edges)
    lone = new.select("rec_id").join(joined.select("rec_id"), "rec_id", "left_anti").select("rec_id", F.concat(F.lit("M-"), "rec_id").alias("entity_id"))
    named = joined.select("rec_id", F.coalesce("entity_id", F.concat(F.lit("M-"), "component")).alias("entity_id")).unionByName(lone)
    return with_primary(named.select("entity_id", "rec_id")), insert_ignore(index, own, ["block", "key", "id"])


def pair_trace(cluster: DataFrame, **stages: DataFrame) -> DataFrame:
    """All pairs of a cluster's members (id) with the stages that saw them."""
    from kinweave.operators.pairs import with_flags

    a, b = cluster.withColumnRenamed("id", "a"), cluster.withColumnRenamed("id", "b")
    pairs = canonical(a.join(b, F.col("a") < F.col("b")), "a", "b")  # members of one cluster, bounded by the caller
    return with_flags(pairs, **stages)


def dashboard(entities: DataFrame, members: DataFrame, queue: DataFrame) -> DataFrame:
    """(entities, records, multi, pending)"""
    sizes = members.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    m = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("multi"))
    return entities.agg(F.count(F.lit(1)).alias("entities")).crossJoin(m).crossJoin(queue.where("bucket = 'needs_review'").agg(F.count(F.lit(1)).alias("pending")))
