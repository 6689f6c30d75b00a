"""Removal of repeated line runs by a suffix array over line-ID sequences.

Every line of every distinct text is a letter; a suffix is the rest of its text
from some line on.  Prefix doubling ranks the suffixes by their first 1, 2, 4,
... lines: the rank at depth 2d of line i is the sorted number of the pair
(rank at i, rank at i+d).  Suffixes of one rank at depth m are an interval of
the suffix array whose neighbours have a longest common prefix of m lines or
more; its first member in document order is the original, the others are
copies.  Doubling goes on until every interval has a single member, and a
suffix that is alone takes no further part.

The longest common prefix of a copy with anything earlier lies between two
depths then.  Its exact length is found by halving: with the steps ..., 4, 2, 1
the members of an interval are split by the rank of the lines that follow.  A
copy that agrees with an earlier member moves on into the narrower interval,
with that interval's first member as its witness; the others stay, and since
the first of a narrower interval stays too, it answers for all that moved.  So
a suffix is in one interval at a time, besides at most one witness row an
interval, and no pairs of suffixes are formed.

Equal texts are one text here: a later copy of a text is one run from end to
end.  Everything is DataFrame or SQL operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinweave.llm.common import join_hot, text_key, without
from kinweave.operators.ranking import global_rank
from kinweave.storage import materialize, scratch

DOC = ["__kw_doc", "__kw_k1", "__kw_k2"]


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key and hashes of the text, its lines as hashes and word counts) for every row that has a text."""
    own = F.col(f"`{text}`")
    lines = F.expr(
        f"transform(split(`{text}`, '\\n'), l -> named_struct('h1', xxhash64(l), 'h2', xxhash64('kw', l), 'words', cast(regexp_count(l, '\\\\S+') as int)))"
    )
    return docs.where(own.isNotNull()).select(F.col(f"`{key}`").alias(DOC[0]), *[c.alias(n) for c, n in zip(text_key(own), DOC[1:])], lines.alias("lines"))


def _is_first() -> Column:
    return F.struct("doc", "line") == F.col("first")


def _ranked(suffixes: DataFrame, parts: list[str], total: int) -> tuple[DataFrame | None, int]:
    """(doc, line, rank, first, any): the suffixes whose ``parts`` several have, with the sorted number of the parts; none if there are none.

    Also how many the largest interval has.  Joins here are sorted at every
    size, hot keys aside: there are so many that what they would broadcast
    fills the driver.
    """
    classes = suffixes.groupBy(*parts).agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("doc", "line")).alias("first")).where("members > 1")
    ranks = global_rank(classes, parts, "rank", gapless=False)
    most = ranks.agg(F.max("members")).first()[0]
    if most is None:
        return None, 0
    return materialize(join_hot(suffixes, ranks, parts, "members", total, most=most).select("doc", "line", "rank", "first", "any"), "suffixes"), most


def _ahead(step: int, column: str) -> Column:
    """The value of ``column`` exactly ``step`` lines on, null where that suffix has no rank."""
    return F.max(column).over(Window.partitionBy("doc").orderBy("line").rangeBetween(step, step))


def _levels(lines: DataFrame, total: int) -> list[tuple[DataFrame, int]]:
    """The ranks at depth 1, 2, 4, ... of all suffixes that share so many lines with another, with the size of the largest interval."""
    levels: list[tuple[DataFrame, int]] = []
    level, most = _ranked(lines, ["h1", "h2"], total)
    while level is not None:
        levels.append((level, most))
        step = 1 << (len(levels) - 1)
        pairs = level.select("doc", "line", F.col("rank").alias("rank1"), _ahead(step, "rank").alias("rank2"), (F.col("any") | _ahead(step, "any")).alias("any"))
        level, most = _ranked(pairs.where("rank2 is not null"), ["rank1", "rank2"], total)
    return levels


def _copies(levels: list[tuple[DataFrame, int]], total: int) -> DataFrame:
    """(doc, line, length, any) of every suffix that shares lines with an earlier one: the length of the longest shared prefix.

    State rows are (doc, line, asks, length, any, n1, n2): the members of the
    intervals named by (n1, n2); the first of an interval answers and asks nothing.
    """
    state: DataFrame | None = None
    done: list[DataFrame] = []
    kept = F.struct("asks", "length", "any", "n1", "n2")
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k][0]
        if k + 1 < len(levels):  # copies at the next depth have their length there; its firsts answer for them here
            own = own.join(levels[k + 1][0].where(~_is_first()).select("doc", "line").hint("merge"), ["doc", "line"], "left_anti")
        rows = own.select("doc", "line", (~_is_first()).alias("asks"), F.lit(1 << k).alias("length"), "any", F.xxhash64(F.lit(k), "rank").alias("n1"), F.xxhash64("rank", F.lit(k)).alias("n2"))
        if k == 0:  # nothing is shorter than a step of 1
            done.append(rows.where("asks"))
            break
        state = rows if state is None else state.unionByName(rows)
        level, most = levels[k - 1]
        step = level.select(F.col("doc").alias("d"), F.col("line").alias("l"), F.col("rank").alias("next"), F.col("any").alias("more"))
        looked = state.join(step.hint("merge"), (F.col("doc") == F.col("d")) & (F.col("line") + F.col("length") == F.col("l")), "left").drop("d", "l")
        narrow = looked.where("next is not null").groupBy("n1", "n2", "next").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("doc", "line")).alias("first")).where("members > 1")
        # the lines that follow an interval's members are different suffixes, so no more than have their rank
        met = join_hot(looked, narrow, ["n1", "n2", "next"], "members", total, "left", most=most)
        inner = F.struct(
            (~_is_first()).alias("asks"), (F.col("length") + F.lit(1 << (k - 1))).alias("length"), (F.col("any") | F.col("more")).alias("any"),
            F.xxhash64(F.lit(k), "n1", "n2", "next").alias("n1"), F.xxhash64("next", "n2", "n1", F.lit(k)).alias("n2"),
        )
        # a copy moves; the first of the narrower interval stays where it is and is in the narrower one as well
        places = F.when(F.col("first").isNull(), F.array(kept)).when(_is_first(), F.array(kept, inner)).otherwise(F.array(inner))
        state = materialize(met.select("doc", "line", F.explode(places).alias("s")).select("doc", "line", "s.*"), "intervals")
    if state is not None:
        done.append(state.where("asks"))
    out = done[0].select("doc", "line", "length", "any")
    for more in done[1:]:
        out = out.unionByName(more.select("doc", "line", "length", "any"))
    return out


def repeated_runs(docs: DataFrame, min_lines: int = 2, min_words: int = 25, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document with a repeated run: key and two text hashes (``__kw_*``), runs (start, n_lines), gone (start, n_lines).

    A run is a stretch of lines that also stands earlier in (document, line)
    order, in the same document or another, and has at least ``min_lines``
    lines with a word among them, or is a line of at least ``min_words`` words.
    ``runs`` lists those that lie in no other run of their document; they may
    overlap.  ``gone`` is their union: the lines to delete, as stretches that
    do not touch.  Both are sorted.
    """
    if min_lines < 2:
        raise ValueError("min_lines must be at least 2; single lines count by min_words")
    rows = _texts(docs, key, text)
    with scratch() as scope:
        first = rows.groupBy(*DOC[1:]).agg(F.min(F.struct(DOC[0], "lines")).alias("f"), F.count(F.lit(1)).alias("members"))
        texts = global_rank(first.select(F.col(f"f.{DOC[0]}").alias(DOC[0]), *DOC[1:], "f.lines", "members"), DOC, "doc")
        lines = materialize(texts.select("doc", F.posexplode("lines").alias("line", "l")).select("doc", "line", "l.h1", "l.h2", "l.words", (F.col("l.words") > 0).alias("any")), "lines")
        total = lines.count()
        levels = _levels(lines, total)
        found = texts.select("doc", F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
        if levels:
            copies = _copies(levels, total)
            found = copies.where((F.col("length") >= min_lines) & F.col("any")).select("doc", F.col("line").alias("start"), (F.col("line") + F.col("length")).alias("end"))
            again = levels[0][0].where(~_is_first()).select("doc", "line")
            wide = lines.where(F.col("words") >= min_words).select("doc", "line").join(again.hint("merge"), ["doc", "line"], "left_semi")
            found = found.unionByName(wide.select("doc", F.col("line").alias("start"), (F.col("line") + 1).alias("end")))
        firsts = texts.select("doc", *DOC).join(_per_text(found).hint("merge"), "doc").select(*DOC, "runs", "gone")
        whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("n_lines")))
        counts = (F.size("lines") >= min_lines) & F.exists("lines", lambda l: l["words"] > 0) | F.exists("lines", lambda l: l["words"] >= min_words)
        copied = texts.where("members > 1").where(counts).select(F.col(DOC[0]).alias("least"), *DOC[1:], F.size("lines").alias("n"), "members")
        names = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").alias(DOC[0]), *[c.alias(n) for c, n in zip(text_key(F.col(f"`{text}`")), DOC[1:])])
        later = join_hot(names, copied, DOC[1:], "members", total).where(~F.col(DOC[0]).eqNullSafe(F.col("least"))).select(*DOC, whole.alias("runs"), whole.alias("gone")).distinct()
        return scope.keep(firsts.unionByName(later), "runs")


def _per_text(found: DataFrame) -> DataFrame:
    """(doc, runs, gone) from all stretches (doc, start, end) that count."""
    before = Window.partitionBy("doc").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    maximal = found.withColumn("reach", F.max("end").over(before)).where("reach is null or reach < end")
    # starts and ends both rise along the maximal runs, so a stretch to delete ends where a run starts beyond its predecessor's end
    island = F.sum((F.coalesce("reach", F.lit(-1)) < F.col("start")).cast("int")).over(Window.partitionBy("doc").orderBy("start"))
    n_lines = (F.col("end") - F.col("start")).alias("n_lines")
    stretches = maximal.withColumn("island", island).groupBy("doc", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.collect_list(F.struct("start", n_lines)).alias("r"))
    gone = F.struct(F.col("s").alias("start"), (F.col("e") - F.col("s")).alias("n_lines"))
    return stretches.groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("runs"), F.array_sort(F.collect_list(gone)).alias("gone"))


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_words: int = 25, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Delete repeated line runs (see ``repeated_runs``) and say what went.

    Returns the rows of ``docs`` with ``text`` shortened and the columns
    n_lines, n_deleted, n_runs and longest_run added (replacing input columns
    of these names).  Lines are separated by a line feed; blank lines belong to
    runs but no run of blank lines alone counts.  A null text stays null and
    has no lines; an empty text is one empty line; a text that is deleted
    wholly becomes empty.  Rows equal in key and text are one document: they
    are treated alike and are not copies of each other.  Null keys sort first.
    Documents of one key and several texts are ordered by hashes of the texts.
    An empty table gives an empty table; other columns are kept.
    """
    docs = without(docs, "n_lines", "n_deleted", "n_runs", "longest_run", *DOC, "__kw_runs", "__kw_gone", "__kw_lines")
    runs = repeated_runs(docs, min_lines, min_words, key, text).withColumnsRenamed({"runs": "__kw_runs", "gone": "__kw_gone"})
    cols = docs.columns
    keyed = docs.select("*", F.col(f"`{key}`").alias(DOC[0]), *[c.alias(n) for c, n in zip(text_key(F.col(f"`{text}`")), DOC[1:])])
    on = [keyed[c].eqNullSafe(runs[c]) for c in DOC]
    # by sorting at every size: the files of the runs are small, the arrays they unpack to need not be
    joined = keyed.join(runs.hint("merge"), on[0] & on[1] & on[2], "left").select(*[keyed[f"`{c}`"] for c in cols], "__kw_runs", "__kw_gone", F.split(keyed[f"`{text}`"], "\n").alias("__kw_lines"))
    # what stays: the lines before the first stretch, between stretches, and after the last
    gaps = (
        "transform(sequence(0, size(__kw_gone)), i -> slice(__kw_lines, "
        "if(i = 0, 0, __kw_gone[i - 1].start + __kw_gone[i - 1].n_lines) + 1, "
        "if(i = size(__kw_gone), size(__kw_lines), __kw_gone[i].start) - if(i = 0, 0, __kw_gone[i - 1].start + __kw_gone[i - 1].n_lines)))"
    )
    shorter = F.expr(f"if(__kw_gone is null, `{text}`, array_join(flatten({gaps}), '\\n'))")
    return joined.select(
        *[shorter.alias(c) if c == text else F.col(f"`{c}`") for c in cols],
        F.expr("coalesce(size(__kw_lines), 0)").alias("n_lines"),
        F.expr("coalesce(aggregate(__kw_gone, 0, (s, r) -> s + r.n_lines), 0)").alias("n_deleted"),
        F.expr("coalesce(size(__kw_runs), 0)").alias("n_runs"),
        F.expr("coalesce(array_max(transform(__kw_runs, r -> r.n_lines)), 0)").alias("longest_run"),
    )
