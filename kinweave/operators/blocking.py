"""Candidate generation: posting lists of blocking keys and their self-join.

A disjunction of key equalities would be a nested loop.  Instead every record
is exploded into (block, key, id) postings, and one equi-join on (block, key)
finds all pairs of all blocks.  A cap per key bounds hot keys before the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.functions.fields import key_hash
from kinweave.functions.phonetic import double_metaphone_udf, soundex, with_code
from kinweave.operators import meeting
from kinweave.operators.pairs import attach
from kinweave.operators.qgram import Vectors
from kinweave.storage import materialize, shuffle_partitions

CAP, NO_LIMIT, MOST_VARIED = 500, 1 << 30, 1_000_000
BLOCKS = ("B1", "B3", "B4", "B5", "B6", "B7", "B8", "B9")


def valid_records(df: DataFrame, column: str = "is_valid") -> DataFrame:
    """Drops records marked false (also as text); null validity is kept."""
    text = F.lower(F.col(column).cast("string"))
    return df.where(text.isNull() | ~text.isin("false", "0"))


def with_key_columns(df: DataFrame) -> DataFrame:
    """Adds dob text, birth year, first-name prefix, phonetic codes and the last four of the id."""
    df = with_code(df, "last", "dm_last", double_metaphone_udf)
    return df.withColumns(
        {
            "dob_text": F.date_format("dob", "yyyy-MM-dd"), "birth_year": F.year("dob").cast("string"), "first3": F.substring("first", 1, 3),
            "sx_first": soundex(F.col("first")), "sx_last": soundex(F.col("last")), "gov_id4": F.substring("gov_id", 6, 4),
        }
    )


def _joined(*parts: str) -> Column:
    """The parts with bars between; null if any is null or empty."""
    cols = [F.col(p) for p in parts]
    whole = cols[0].isNotNull() & (cols[0] != "")
    for c in cols[1:]:
        whole = whole & c.isNotNull() & (c != "")
    return F.when(whole, F.concat_ws("|", *cols))


def block_keys() -> dict[str, Column]:
    """The key expression of each block over ``with_key_columns``; B5 is an array."""
    return {
        "B1": _joined("gov_id"),
        "B3": _joined("dm_last", "dob_text"),
        "B4": _joined("last", "birth_year", "first3"),
        "B5": F.col("phones"),
        "B6": _joined("email"),
        "B7": _joined("dm_last", "postal", "birth_year"),
        "B8": _joined("sx_first", "sx_last", "birth_year"),
        "B9": _joined("last", "first", "gov_id4"),
    }


def postings(records: DataFrame, blocks: tuple[str, ...] = BLOCKS, id_col: str = "rec_id") -> DataFrame:
    """(block, key, id) of every valid record; records lacking a part of a key are not in its block."""
    keys = block_keys()
    keyed = with_key_columns(valid_records(records))

    def listed(b: str) -> Column:
        values = F.coalesce(keys[b], F.array().cast("array<string>")) if b == "B5" else F.array(keys[b])
        return F.transform(values, lambda k: F.struct(F.lit(b).alias("block"), k.alias("key")))

    lists = [listed(b) for b in blocks]
    return keyed.select(F.col(id_col).alias("id"), F.explode(F.flatten(F.array(*lists))).alias("p")).select("p.block", "p.key", "id").where("key is not null and key <> ''")


def cap_keys(post: DataFrame, cap: int = CAP, policy: str = "cap") -> DataFrame:
    """Bounds the ids of a key: 'cap' keeps the first ``cap`` by id, 'skip' drops keys that have more."""
    per_key = Window.partitionBy("block", "key")
    if policy == "cap":
        return post.withColumn("_n", F.row_number().over(per_key.orderBy("id"))).where(F.col("_n") <= cap).drop("_n")
    if policy == "skip":
        sizes = post.groupBy("block", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= cap)
        return post.join(sizes.select("block", "key"), ["block", "key"], "left_semi")
    raise ValueError(f"unknown policy {policy!r}")


def pairs_within_keys(post: DataFrame) -> DataFrame:
    """(id_a, id_b, blocks, n_blocks): distinct pairs that share a key, id_a < id_b."""
    a, b = post.withColumnRenamed("id", "id_a"), post.withColumnRenamed("id", "id_b")
    met = a.join(b, ["block", "key"]).where("id_a < id_b")
    return met.groupBy("id_a", "id_b").agg(F.array_sort(F.collect_set("block")).alias("blocks")).withColumn("n_blocks", F.size("blocks"))


def candidate_pairs(records: DataFrame, blocks: tuple[str, ...] = BLOCKS, cap: int = CAP, policy: str = "cap", carry: tuple[str, ...] = ()) -> DataFrame:
    """Batch blocking: postings, cap, self-join; ``carry`` as in ``group_pairs``.

    Records of equal keys (and carried columns) are one class.  Postings of
    classes bring all their keys to the join, as 64-bit hashes that are checked
    to be free of collisions (else the keys themselves), and two classes meet at
    the first key they share.  So pairs are never shuffled.
    """
    base = valid_records(records)
    if repeats(base, "rec_id"):
        pairs = pairs_within_keys(cap_keys(postings(records, blocks), cap, policy))
        return attach(pairs, base, list(carry)) if carry else pairs
    known = _Classes(base, blocks, cap, policy, carry, F.array_sort(F.collect_list("id")).alias("ids"))
    inner = known.table.where("size(ids) > 1").select(known.named(known.has()), *[F.col(c).alias(f"{c}_{s}") for c in carry for s in "lr"], F.explode("ids").alias("id_a"), "ids")
    inner = inner.select("*", F.explode("ids").alias("id_b")).where("id_a < id_b").drop("ids")
    met = known.meetings("ids", *carry).where(F.get("ids_l", F.lit(0)) < F.get("ids_r", F.lit(0)))
    outer = met.select(known.named(known.same()), *[f"{c}_{s}" for c in carry for s in "lr"], F.explode("ids_l").alias("x"), "ids_r").select("*", F.explode("ids_r").alias("y"))
    sides = [F.when(F.col("x") < F.col("y"), F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{t}")).alias(f"{c}_{s}") for c in carry for s, t in ("lr", "rl")]
    outer = outer.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "blocks", *sides)
    return outer.unionByName(inner).withColumn("n_blocks", F.size("blocks"))


class Stacked:
    """``candidate_pairs`` with, as block QG, pairs of one date of birth whose texts are ``near``; records have one row an id.

    Pairs of one date are made at the date, all others at the first key they
    share, so the two sets are united without a shuffle or table of pairs.  A
    pair's blocks are bits of ``mask``, in the order of ``names``.
    """

    def __init__(self, records: DataFrame, near: Vectors, text: Column, blocks: tuple[str, ...] = BLOCKS, cap: int = CAP):
        base = valid_records(records).withColumn("_t", text)
        wide = {"QG": F.date_format("dob", "yyyy-MM-dd")}
        self.known = known = _Classes(base, blocks, cap, "cap", ("_t",), F.array_sort(F.collect_list("id")).alias("ids"), wide=wide)
        known.table = materialize(known.table, "classes", release=True)
        self.near, self.names, self.spark = near, ("QG", *blocks), records.sparkSession
        self.own, self.post = (list(known.own.values()), known.many, near), known.posts(lean=True)

    def blocks(self) -> Column:
        bits = {b: F.col("mask").bitwiseAND(1 << i) != 0 for i, b in enumerate(self.names)}
        return F.array_compact(F.array(*[F.when(bits[b], F.lit(b)) for b in sorted(bits)]))

    def masks(self) -> DataFrame:
        """(mask, blocks) of every set of blocks."""
        return self.spark.range(1, 1 << len(self.names)).select(F.col("id").cast("int").alias("mask")).select("mask", self.blocks().alias("blocks"))

    def pairs(self) -> DataFrame:
        """(id_a, id_b, mask)"""
        return _met(self.post, meeting.stacked(*self.own), "id_a string, id_b string, mask int")

    def counts(self, k: int = 0) -> DataFrame:
        """(id_a, mask, n): how many pairs have each mask, and how many pairs only QG finds each record has, up to ``k``."""
        return materialize(_met(self.post, meeting.counted(*self.own, k), "id_a string, mask int, n long"), "counts", release=True)

    def best(self, counts: DataFrame, weights: list[float], lone: float, k: int) -> DataFrame:
        """(id_a, id_b, mask): pairs among the ``k`` heaviest of either end, ties to the greater pair; ``lone`` is more than every weight of other pairs.

        So pairs that only QG finds come first, and their ranks are known within
        a date.  Other pairs are ranked only for records that have fewer than
        ``k`` of those, from the heaviest at each key.
        """
        if max(weights[2:]) >= lone:
            raise ValueError("pairs of other blocks may be as heavy as those only QG finds")
        first = _met(self.post.where("_slot = 0"), meeting.lone_best(*self.own, k), "id_a string, id_b string, mask int")
        order = {w: i for i, w in enumerate(sorted(set(weights)))}
        rank = [order[w] for w in weights]
        have = counts.where("mask is null").select(F.col("id_a").alias("id"), (k - F.col("n")).cast("int").alias("need"))
        table = self.known.table
        members = table.select(*[c for c in table.columns if c != "ids"], F.explode("ids").alias("id")).join(have, "id", "left").withColumn("need", F.coalesce("need", F.lit(k)))
        same = [c for c in table.columns if c != "ids"]
        asked = members.groupBy(*same).agg(F.collect_list("id").alias("ids"), F.collect_list("need").alias("needs"))
        self.known.table = materialize(asked, "asked", release=True)
        post, self.known.table = self.known.posts(lean=True), table
        ends = _met(post, meeting.block_best(*self.own, rank), "node string, need int, id_a string, id_b string, mask int")
        heavy = F.get(F.array(*[F.lit(r) for r in rank]), F.col("mask"))
        window = Window.partitionBy("node").orderBy(heavy.desc(), F.col("id_a").desc(), F.col("id_b").desc())
        rest = ends.withColumn("_r", F.row_number().over(window)).where("_r <= need").select("id_a", "id_b", "mask").dropDuplicates(["id_a", "id_b"])
        return first.unionByName(rest)


def _met(post: DataFrame, run: Callable, schema: str) -> DataFrame:
    return post.repartition(shuffle_partitions(post.sparkSession), "_slot", "_key").sortWithinPartitions("_slot", "_key").mapInArrow(run, schema)


def stacked_pairs(records: DataFrame, near: Vectors, text: Column, blocks: tuple[str, ...] = BLOCKS, cap: int = CAP) -> DataFrame:
    """(id_a, id_b, blocks) of ``Stacked``."""
    stacked = Stacked(records, near, text, blocks, cap)
    return stacked.pairs().select("id_a", "id_b", stacked.blocks().alias("blocks"))


def candidate_counts(records: DataFrame, blocks: tuple[str, ...] = BLOCKS, cap: int = CAP, policy: str = "cap") -> DataFrame:
    """(blocks, n_blocks, pairs): how many of ``candidate_pairs`` share just these blocks; classes are counted, no pair is made."""
    base = valid_records(records)
    if repeats(base, "rec_id"):
        return candidate_pairs(records, blocks, cap, policy).groupBy("blocks", "n_blocks").agg(F.count(F.lit(1)).alias("pairs"))
    known = _Classes(base, blocks, cap, policy, (), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    known.table = table = materialize(known.table, "classes")
    # lists of keys become columns where they are short: the tests of the join then compile to small code
    width = {c: table.agg(F.max(F.size(c))).first()[0] or 1 for c in known.many}
    parts = {b: [f"{c}_{j}" for j in range(width[c])] if width.get(c, 9) <= 3 else [c] for b, c in known.own.items()}
    flat = {b: c not in known.many or width[c] <= 3 for b, c in known.own.items()}
    post = known.placed(table).select("_slot", "_key", "least", "n", *[F.get(c, F.lit(j)).alias(f"{c}_{j}") if c in width and flat[b] else F.col(c) for b, c in known.own.items() for j in range(len(parts[b]))])
    one, two = (post.select("_slot", "_key", *[F.col(c).alias(f"{c}_{s}") for c in post.columns[2:]]) for s in "lr")

    def within(left: str, b: str) -> Column:
        """Whether a key of the left is one of the right's."""
        out = F.col(f"{left}_l") == F.col(f"{parts[b][0]}_r")
        for right in parts[b][1:]:
            out = F.coalesce(out, F.lit(False)) | (F.col(f"{left}_l") == F.col(f"{right}_r"))
        return out

    same, once = {}, F.lit(True)
    for i, (b, c) in enumerate(known.own.items()):
        same[b] = F.coalesce(*[F.when(within(x, b), True) for x in parts[b]]) if flat[b] else F.arrays_overlap(f"{c}_l", f"{c}_r")
        if c in known.many:
            least = F.coalesce(*[F.when(within(x, b), F.col(f"{x}_l")) for x in parts[b]]) if flat[b] else F.array_min(F.array_intersect(f"{c}_l", f"{c}_r"))
            once = once & ((F.col("_slot") != i) | (least == F.col("_key")))

    first = F.coalesce(*[F.when(test, i) for i, test in enumerate(same.values())])
    inner = table.where("n > 1").select(known.named(known.has()), F.expr("n * (n - 1) div 2").alias("pairs"))
    met = one.join(two, ["_slot", "_key"]).where((F.col("least_l") < F.col("least_r")) & (first == F.col("_slot")) & once).select(known.named(same), (F.col("n_l") * F.col("n_r")).alias("pairs"))
    both = [df.groupBy("blocks").agg(F.sum("pairs").alias("pairs")) for df in (met, inner)]
    return both[0].unionByName(both[1]).groupBy("blocks").agg(F.sum("pairs").alias("pairs")).select("blocks", F.size("blocks").alias("n_blocks"), "pairs")


class _Classes:
    """``table``: records of equal keys (and carried columns) with what ``members`` aggregates of them.

    Keys are in columns ``own`` names.  Classes that share the first key they
    have lie next to each other, so that their postings do in the shuffle files,
    where what they have in common is compressed away.  ``wide``: blocks with
    keys of their own that come first and are never capped.
    """

    def __init__(self, base: DataFrame, blocks: tuple[str, ...], cap: int, policy: str, carry: tuple[str, ...], *members: Column, wide: dict[str, Column] | None = None):
        if policy not in ("cap", "skip"):
            raise ValueError(f"unknown policy {policy!r}")
        self.varied: DataFrame | None = None
        keys = block_keys() | (wide or {})
        blocks = (*(wide or {}), *blocks)
        capped = F.col("_slot") >= len(wide or {})
        self.own = own = {b: f"_k{i}" for i, b in enumerate(blocks)}
        self.many = many = [f"_k{i}" for i, b in enumerate(blocks) if b == "B5"]
        placed = self.placed
        text = {c: F.array_distinct(F.filter(keys[b], lambda k: k != "")) if c in many else keys[b] for b, c in own.items()}
        keyed = with_key_columns(base).select(F.col("rec_id").alias("id"), *carry, *[k.alias(c) for c, k in text.items()])
        code = lambda c: F.transform(c, lambda k: F.xxhash64(k)) if c in many else F.when(F.col(c).isNotNull(), F.xxhash64(c))
        sizes = placed(keyed.select("id", *own.values())).groupBy("_slot", "_key").agg(F.count(F.lit(1)).alias("n")).groupBy("_slot", F.xxhash64("_key").alias("_code"))
        odd = materialize(sizes.agg(F.count(F.lit(1)).alias("kinds"), F.max(F.when(capped, F.col("n"))).alias("n")).where((F.col("kinds") > 1) | (capped & (F.col("n") > cap))), "odd")
        clash, large = odd.agg(F.max(F.col("kinds") > 1), F.max(F.col("n") > cap)).first()
        coded = keyed if clash else keyed.withColumns({c: code(c) for c in own.values()})
        if large:
            over = placed(coded.select("id", *own.values())).where(capped)
            if policy == "cap":
                over = over.withColumn("_n", F.row_number().over(Window.partitionBy("_slot", "_key").orderBy("id"))).where(F.col("_n") > cap)
            else:
                over = over.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_slot", "_key"))).where(F.col("_n") > cap)
            over = over.groupBy("id").agg(F.collect_list(F.struct("_slot", "_key")).alias("_over"))
            gone = lambda i: F.transform(F.filter("_over", lambda o: o["_slot"] == i), lambda o: o["_key"])
            coded = coded.join(over, "id", "left").withColumn("_over", F.coalesce("_over", F.array())).withColumns(
                {c: F.array_except(c, gone(i)) if c in many else F.when(~F.array_contains(gone(i), F.coalesce(c, F.lit("" if clash else 0))), F.col(c)) for i, c in enumerate(own.values())}
            ).drop("_over")
        coded = coded.withColumns({c: F.array_sort(F.coalesce(c, F.array())) for c in many})
        some = F.lit(False)
        for test in self.has().values():
            some = some | test
        near = F.coalesce(*[F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in own.values() if c not in many], *[F.xxhash64(c) for c in many])
        rows = coded.where(some & F.col("id").isNotNull()).withColumn("_near", near).repartition("_near")
        self.table = rows.groupBy("_near", *own.values(), *carry).agg(*members).sortWithinPartitions("_near").drop("_near")

    def placed(self, df: DataFrame) -> DataFrame:
        """One row for each key (_slot, _key)."""

        def posting(i: int, key: Column) -> Column:
            return F.struct(F.lit(i).alias("_slot"), key.alias("_key"))

        # a struct for each key of its own compiles; only lists of keys need a lambda
        single = F.array(*[posting(i, F.col(c)) for i, c in enumerate(self.own.values()) if c not in self.many])
        lists = [self._each(posting, i, c) for i, c in enumerate(self.own.values()) if c in self.many]
        return df.select("*", F.inline(F.concat(single, *lists) if len(lists) < len(self.own) else F.concat(*lists))).where("_key is not null")

    @staticmethod
    def _each(posting: Callable[[int, Column], Column], i: int, c: str) -> Column:
        return F.transform(F.coalesce(c, F.array()), lambda k: posting(i, k))

    def has(self) -> dict[str, Column]:
        """Whether a class has a key of each block."""
        return {b: F.size(c) > 0 if c in self.many else F.col(c).isNotNull() for b, c in self.own.items()}

    def same(self) -> dict[str, Column]:
        """Whether both sides of a meeting share a key of each block."""
        return {b: F.arrays_overlap(f"{c}_l", f"{c}_r") if c in self.many else F.col(f"{c}_l") == F.col(f"{c}_r") for b, c in self.own.items()}

    def named(self, tests: dict[str, Column]) -> Column:
        return F.array_compact(F.array(*[F.when(tests[b], F.lit(b)) for b in sorted(self.own)])).alias("blocks")

    def posts(self, lean: bool = False) -> DataFrame:
        """Postings of the classes; ``lean``: keys whose classes all share the first block's key are left out, as in ``group_pairs``."""
        post = self.placed(self.table)
        if lean:
            if self.varied is None:
                groups = post.where("_slot > 0").groupBy(F.xxhash64("_slot", "_key").alias("_code")).agg(F.min("_k0").alias("lo"), F.max("_k0").alias("hi"), F.max(F.col("_k0").isNull()).alias("none"))
                self.varied = materialize(groups.where("none or lo <> hi").select("_code"), "varied", release=True)
            if self.varied.count() <= MOST_VARIED:
                rest = post.where("_slot > 0").join(F.broadcast(self.varied), F.xxhash64("_slot", "_key") == F.col("_code"), "left_semi")  # at most MOST_VARIED rows
                post = post.where("_slot = 0").unionByName(rest)
        return post

    def meetings(self, *columns: str) -> DataFrame:
        """Classes (left, right) that share a key, in both orders, at the first key they share; also each with itself."""
        post, own = self.posts(), self.own
        a, b = (post.select("_slot", "_key", *[F.col(c).alias(f"{c}_{s}") for c in (*columns, *own.values())]) for s in "lr")
        least = lambda c: F.array_min(F.array_intersect(f"{c}_l", f"{c}_r"))
        first = F.coalesce(*[F.when(test, i) for i, test in enumerate(self.same().values())])
        once = F.lit(True)
        for i, c in enumerate(own.values()):
            if c in self.many:
                once = F.when(F.col("_slot") != i, True).when((F.size(f"{c}_l") == 1) | (F.size(f"{c}_r") == 1), True).otherwise(least(c) == F.col("_key"))
        return a.join(b, ["_slot", "_key"]).where((first == F.col("_slot")) & once)


def union_pairs(*pairs: DataFrame) -> DataFrame:
    """Union of pair tables, the blocks of a pair merged."""
    all_pairs = pairs[0].select("id_a", "id_b", "blocks")
    for p in pairs[1:]:
        all_pairs = all_pairs.unionByName(p.select("id_a", "id_b", "blocks"))
    tokens = all_pairs.select("id_a", "id_b", F.explode("blocks").alias("block"))
    return tokens.groupBy("id_a", "id_b").agg(F.array_sort(F.collect_set("block")).alias("blocks")).withColumn("n_blocks", F.size("blocks"))


def inference_pairs(new: DataFrame, index: DataFrame, blocks: tuple[str, ...] = BLOCKS, cap: int = CAP) -> DataFrame:
    """(new_id, id_a, id_b, blocks, n_blocks): pairs of new records with indexed ones.

    ``index``: (block, key, id).  At most ``cap`` indexed ids of each key, by
    id, are met; pairs are canonical, and ``new_id`` says which side is new.
    """
    asked = postings(new, blocks).withColumnRenamed("id", "new_id")
    met = asked.join(cap_keys(index, cap), ["block", "key"]).where("new_id <> id")
    pairs = met.select("new_id", F.least("new_id", "id").alias("id_a"), F.greatest("new_id", "id").alias("id_b"), "block")
    return pairs.groupBy("new_id", "id_a", "id_b").agg(F.array_sort(F.collect_set("block")).alias("blocks")).withColumn("n_blocks", F.size("blocks"))


def hashed_postings(post: DataFrame, secret: tuple[str, ...] = ("B1", "B6")) -> DataFrame:
    """Postings whose identifier keys are replaced by their SHA-256."""
    return post.withColumn("key", F.when(F.col("block").isin(*secret), key_hash(F.col("key"))).otherwise(F.col("key")))


def repeats(records: DataFrame, id_col: str = "rec_id") -> bool:
    """Whether an id has several rows."""
    return not records.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()


def group_pairs(df: DataFrame, keys: dict[str, Column], limit: int, id_col: str = "rec_id", carry: tuple[str, ...] = (), blocks: bool = True) -> DataFrame:
    """Pairs that share any of the given keys; groups of over ``limit`` records are skipped.

    ``carry``: columns of the records that come along as ``<column>_l`` and
    ``<column>_r``.  Postings bring all keys of their record to the join, and a
    pair is made at the first key its records share, so pairs are neither made
    twice nor shuffled; what is shuffled grows with the records.  Groups of a
    later key whose records all share the first key have no pair left to make,
    so they are left out of the shuffle: put the key of the largest groups first.
    Without ``blocks`` a posting brings only the keys before its own.  Where an id
    has several rows, its pairs are made distinct by a shuffle instead.
    """
    names = list(keys)
    base = df.select(F.col(id_col).alias("id"), *carry, *[F.nullif(k.cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys.values())])
    slots = F.posexplode(F.array(*[f"_k{i}" for i in range(len(names))])).alias("_slot", "_key")
    post = base.select("id", slots).where("_key is not null")
    if repeats(df, id_col):
        named = post.select(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_slot") + 1).alias("block"), F.col("_key").alias("key"), "id")
        pairs = pairs_within_keys(cap_keys(named, limit, "skip"))
        pairs = attach(pairs, df, list(carry), id_col) if carry else pairs
        return pairs if blocks else pairs.drop("blocks", "n_blocks")
    if limit < NO_LIMIT:
        large = materialize(post.groupBy("_slot", "_key").count().where(F.col("count") > limit).select("_slot", "_key", F.lit(True).alias("_large")), "large")
        for (i,) in large.select("_slot").distinct().collect():  # one row for each key scheme
            base = base.join(large.where(F.col("_slot") == i).select(F.col("_key").alias(f"_k{i}"), "_large"), f"_k{i}", "left").withColumn(f"_k{i}", F.when(F.col("_large").isNull(), F.col(f"_k{i}"))).drop("_large")
    own = [f"_k{i}" for i in range(len(names))]
    placed = _postings_of(base, own, carry, blocks)
    a = placed.select("_slot", "_key", F.col("id").alias("id_a"), *[F.col(c).alias(f"{c}_l") for c in (*carry, *own)])
    b = placed.select("_slot", "_key", F.col("id").alias("id_b"), *[F.col(c).alias(f"{c}_r") for c in (*carry, *own)])
    same = {n: F.col(f"{k}_l") == F.col(f"{k}_r") for n, k in zip(names, own)}
    first = F.lit(True)
    for i, test in enumerate(same.values()):
        first = first & ((F.col("_slot") <= i) | ~F.coalesce(test, F.lit(False)))
    met = a.join(b, ["_slot", "_key"]).where((F.col("id_a") < F.col("id_b")) & first)
    sides = [f"{c}_{s}" for c in carry for s in "lr"]
    if not blocks:
        return met.select("id_a", "id_b", *sides)
    found = F.array_compact(F.array(*[F.when(same[n], F.lit(n)) for n in sorted(names)]))
    return met.select("id_a", "id_b", found.alias("blocks"), *sides).withColumn("n_blocks", F.size("blocks"))


def _postings_of(base: DataFrame, own: list[str], carry: tuple[str, ...], whole: bool) -> DataFrame:
    """(id, carry, own, _slot, _key): a row for each key of a record, with all keys (``whole``) or those before its own; groups without new pairs are left out."""
    kept = lambda i: own if whole else [F.col(k) if j < i else F.lit(None).cast("string").alias(k) for j, k in enumerate(own)]
    varied = _varied(base, own)
    parts = [base.select("id", *carry, *kept(i), F.lit(i).alias("_slot"), F.col(k).alias("_key")).where("_key is not null") for i, k in enumerate(own)]
    if varied is not None:
        parts[1:] = [df.join(F.broadcast(varied.where(F.col("_s") == i).select("_code")), F.xxhash64("_key") == F.col("_code"), "left_semi") for i, df in enumerate(parts[1:], 1)]  # at most MOST_VARIED rows
    placed = None
    for df in parts:
        # records alike lie next to each other in the shuffle files, where what they have in common is compressed away
        near = df.sortWithinPartitions("_key", *[F.col(c) for c in carry]) if carry else df
        placed = near if placed is None else placed.unionByName(near)
    return placed


def met_in_groups(df: DataFrame, keys: dict[str, Column], carry: tuple[str, ...], run: Callable[[list[str]], Callable], schema: str, id_col: str = "rec_id") -> DataFrame:
    """What ``run`` makes of the groups of ``group_pairs`` (its argument: the columns of the keys), in arrays and without a join; ids have one row each."""
    own = [f"_k{i}" for i in range(len(keys))]
    base = df.select(F.col(id_col).alias("id"), *carry, *[F.nullif(k.cast("string"), F.lit("")).alias(o) for o, k in zip(own, keys.values())]).where("id is not null")
    return _met(_postings_of(base, own, carry, False), run(own), schema)


def _varied(base: DataFrame, own: list[str]) -> DataFrame | None:
    """(_s, _code): hashes of the later keys whose records do not all share the first key; None if they are too many to broadcast."""
    if len(own) < 2:
        return None
    rows = [base.where(F.col(k).isNotNull()).select(F.lit(i).alias("_s"), F.xxhash64(k).alias("_code"), F.when(F.col(own[0]).isNotNull(), F.xxhash64(own[0])).alias("_h")) for i, k in enumerate(own) if i]
    placed = rows[0]
    for df in rows[1:]:
        placed = placed.unionByName(df)
    groups = placed.groupBy("_s", "_code").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"), F.max(F.col("_h").isNull()).alias("none"))
    found = materialize(groups.where("none or lo <> hi").select("_s", "_code"), "varied", release=True)
    return found if found.count() <= MOST_VARIED else None


def loose_pairs(records: DataFrame, limit: int = 2000) -> DataFrame:
    """The wide candidate set: same date of birth or same Soundex of the last name."""
    return group_pairs(valid_records(records), {"dob": F.date_format("dob", "yyyy-MM-dd"), "sx": soundex(F.col("last"))}, limit)


def oracle_pairs(records: DataFrame, limit: int = 2000) -> DataFrame:
    """Pairs that share a strong identifier: government id or email."""
    return group_pairs(valid_records(records), {"gov_id": F.col("gov_id"), "email": F.col("email")}, limit)


def first_name_dob_pairs(records: DataFrame, limit: int = 2000) -> DataFrame:
    """Experimental blocks on first name and date of birth, for pairs in which an id is missing."""
    dob = F.date_format("dob", "yyyy-MM-dd")
    keys = {"X1": F.when(F.col("first").isNotNull() & dob.isNotNull(), F.concat_ws("|", "first", dob)), "X2": F.when(soundex(F.col("first")).isNotNull() & dob.isNotNull(), F.concat_ws("|", soundex(F.col("first")), dob))}
    base = valid_records(records)
    pairs = group_pairs(base, keys, limit)
    ids = base.select("rec_id", F.col("gov_id").isNull().alias("none"))
    a, b = ids.withColumnsRenamed({"rec_id": "id_a", "none": "none_a"}), ids.withColumnsRenamed({"rec_id": "id_b", "none": "none_b"})
    return pairs.join(a, "id_a").join(b, "id_b").where("none_a or none_b").drop("none_a", "none_b")


def sorted_neighbourhood(records: DataFrame, key: Column, window: int, id_col: str = "rec_id") -> DataFrame:
    """(id_a, id_b): pairs at most window - 1 places apart in the order of (key, id).

    Ranks come from a range partitioning with per-partition offsets, so no
    single task sorts all rows; a row joins its successors by equal rank, each
    row copied once for each step of the window.
    """
    from kinweave.operators.ranking import global_rank

    ranked = global_rank(records.select(F.col(id_col).alias("id"), key.alias("k")).where("k is not null"), ["k", "id"], "rn")
    ahead = ranked.select(F.col("id").alias("other"), F.explode(F.sequence(F.col("rn") - (window - 1), F.col("rn") - 1)).alias("rn"))
    met = ranked.join(ahead, "rn")
    return met.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def adaptive_neighbourhood(records: DataFrame, key: Column, prefix: int = 6, least: int = 5, most: int = 50, id_col: str = "rec_id") -> DataFrame:
    """As ``sorted_neighbourhood`` with a window as wide as the rows that share the key's prefix, within bounds."""
    from kinweave.operators.ranking import global_rank

    ranked = global_rank(records.select(F.col(id_col).alias("id"), key.alias("k")).where("k is not null"), ["k", "id"], "rn").withColumn("p", F.substring("k", 1, prefix))
    density = ranked.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    sized = ranked.join(density, "p").withColumn("w", F.greatest(F.lit(least), F.least(F.lit(most), F.col("n").cast("int"))))
    ahead = sized.select(F.col("id").alias("other"), F.explode(F.expr("sequence(rn + 1, rn + w - 1)")).alias("rn"))
    met = ranked.join(ahead, "rn")
    return met.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def multi_pass(*passes: tuple[str, DataFrame]) -> DataFrame:
    """(pass, pairs, added): what each pass finds and what it adds to those before."""
    spark = passes[0][1].sparkSession
    out, seen = None, None
    for name, pairs in passes:
        own = pairs.select("id_a", "id_b").distinct()
        fresh = own if seen is None else own.join(seen, ["id_a", "id_b"], "left_anti")
        row = own.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(fresh.agg(F.count(F.lit(1)).alias("added"))).select(F.lit(name).alias("pass"), "pairs", "added")
        out = row if out is None else out.unionByName(row)
        seen = own if seen is None else seen.unionByName(fresh)
    return out if out is not None else spark.createDataFrame([], "pass string, pairs long, added long")


def value_pairs(records: DataFrame, array_col: str = "phones", id_col: str = "rec_id") -> DataFrame:
    """Pairs that share a value of an array column, with the number of shared values."""
    v = records.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(array_col)).alias("v"))
    met = v.withColumnRenamed("id", "id_a").join(v.withColumnRenamed("id", "id_b"), "v").where("id_a < id_b")
    return met.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("shared"))


def minhash_lsh_pairs(records: DataFrame, text: Column, distance: float = 0.4, tables: int = 16, id_col: str = "rec_id") -> DataFrame:
    """(id_a, id_b, distance): near super-strings by Spark's MinHash LSH over character 3-grams."""
    from pyspark.ml.feature import HashingTF, MinHashLSH

    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("t") - 2)), lambda i: F.substr(F.col("t"), i, F.lit(3)))
    base = records.select(F.col(id_col).alias("id"), F.upper(text).alias("t")).where("length(t) > 0").withColumn("grams", grams)
    vectors = HashingTF(inputCol="grams", outputCol="v", numFeatures=1 << 18, binary=True).transform(base).select("id", "v")
    model = MinHashLSH(inputCol="v", outputCol="h", numHashTables=tables, seed=42).fit(vectors)
    near = model.approxSimilarityJoin(vectors, vectors, distance, "distance")
    return near.select(F.col("datasetA.id").alias("id_a"), F.col("datasetB.id").alias("id_b"), "distance").where("id_a < id_b")


def block_stats(pairs: DataFrame) -> DataFrame:
    """(block, pairs, only_here): pairs of each block and those no other block finds; pairs, or ``candidate_counts`` of them."""
    tokens = _counted(pairs).select(F.explode("blocks").alias("block"), "n_blocks", "pairs")
    return tokens.groupBy("block").agg(F.sum("pairs").alias("pairs"), F.sum(F.when(F.col("n_blocks") == 1, F.col("pairs")).otherwise(0)).alias("only_here"))


def block_overlap(pairs: DataFrame) -> DataFrame:
    """(block_a, block_b, both, jaccard) for every ordered pair of blocks that share pairs; of pairs, or ``candidate_counts`` of them."""
    t = _counted(pairs).select(F.explode("blocks").alias("block_a"), "blocks", "pairs").select("block_a", F.explode("blocks").alias("block_b"), "pairs")
    both = t.groupBy("block_a", "block_b").agg(F.sum("pairs").alias("both"))
    own = both.where("block_a = block_b").select(F.col("block_a").alias("b"), F.col("both").alias("n"))
    a, b = own.withColumnsRenamed({"b": "block_a", "n": "n_a"}), own.withColumnsRenamed({"b": "block_b", "n": "n_b"})
    return both.join(a, "block_a").join(b, "block_b").select("block_a", "block_b", "both", (F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).alias("jaccard"))


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs if "pairs" in pairs.columns else pairs.select("blocks", "n_blocks", F.lit(1).cast("long").alias("pairs"))


def block_advice(stats: DataFrame, keep_share: float = 0.05) -> DataFrame:
    """Keep a block if it alone finds at least ``keep_share`` of its pairs, review it if any, else remove it."""
    share = F.col("only_here") / F.col("pairs")
    return stats.withColumn("advice", F.when(share >= keep_share, "keep").when(F.col("only_here") > 0, "review").otherwise("remove"))


def block_counts_histogram(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("n_blocks").agg(F.count(F.lit(1)).alias("pairs"))


def blocking_metrics(pairs: DataFrame, truth: DataFrame, n_records: int) -> DataFrame:
    """(pairs, found, completeness, quality, reduction) of a candidate set against true pairs."""
    found = pairs.select("id_a", "id_b").join(truth.select("id_a", "id_b"), ["id_a", "id_b"], "left_semi").agg(F.count(F.lit(1)).alias("found"))
    n = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    t = truth.agg(F.count(F.lit(1)).alias("truth"))
    total = F.lit(n_records) * F.lit(n_records - 1) / 2
    return n.crossJoin(found).crossJoin(t).select("pairs", "found", F.try_divide("found", "truth").alias("completeness"), F.try_divide("found", "pairs").alias("quality"), (1 - F.col("pairs") / total).alias("reduction"))
