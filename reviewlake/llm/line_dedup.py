"""Operator 8, repeated runs of lines, by a suffix array over line ids.

Lines are numbered by content. A line that occurs once can be in no repeated run, so it acts as a
unique end mark: the suffix array holds the suffixes that begin at repeated lines. It is built by
prefix doubling: level k ranks suffixes by their first 2^k lines; the next level sorts the pairs
(rank of the first half, rank of the second half) by range and numbers them in that order, so ranks
keep the order of the suffixes. Suffixes whose prefix of a level is shared by no other drop out, so
the levels shrink, and there are about log2 of the longest repeated run of them. One equal rank is
one interval of the suffix array whose longest common prefix is at least 2^k lines.

A run is maximal and counts if it has at least ``min_words`` words. It is the union of the shortest
runs of so many words that begin, or end, at each of its lines; each of those has m lines, and its
interval (longest common prefix at least m) is named by m and two ranks of level floor(log2 m), at
its begin and 2^k lines before its end. The earliest suffix of an interval (by document id, text
hash, line) is kept, and the lines of all later ones are deleted, so every distinct line stays
somewhere. Runs never cross documents.

Only (document, line number, rank) rows move between levels, keyed so that no frequent line or
passage makes a hot task: pairs are summed before their shuffle, and Spark splits the skewed sides
of the joins. Every level is written, so a lost executor costs one step.

Defined cases: null text stays null and has no lines; an empty text is one empty line without
words; rows of equal id and text are one document listed twice and get the same result; documents
of equal id and different text are ordered by text hash, null ids come first; a document may lose
all its lines (its text is then empty); an empty table gives no rows; other columns are kept, and
``n_lines``, ``n_deleted``, ``deleted`` replace columns of those names. Ids are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .curriculum import WORD

KEY = ["d", "th"]
NO_ID = -(1 << 63)


def _key(id_col: str, text_col: str) -> list[Column]:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.col(text_col)).alias("th")]


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, th, pos, h1, h2, words) of every line; h1 and h2 are two hashes of its content."""
    line = F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.struct(
        F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    return (docs.where(F.col(text_col).isNotNull()).select(*_key(id_col, text_col), F.posexplode(line).alias("pos", "line"))
            .select(*KEY, "pos", "line.h1", "line.h2", "line.words"))


def _numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The groups of ``by`` with two or more rows, numbered in their order."""
    groups = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    return stored(groups.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), name)


def suffix_levels(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The repeated lines (d, th, pos, words), and per level k the ranks (d, th, pos, rank) by
    the first 2^k lines of the suffixes that share them with another."""
    repeated = _numbered(lines, ["h1", "h2"], "line-ids")
    first = stored(lines.join(repeated, ["h1", "h2"]).select(*KEY, "pos", "words", "rank").dropDuplicates([*KEY, "pos"]), "line-level")
    levels, step = [first.select(*KEY, "pos", "rank")], 1
    while True:
        half = levels[-1]
        later = half.select(*KEY, (F.col("pos") - step).alias("pos"), F.col("rank").alias("second"))
        pairs = stored(half.withColumnRenamed("rank", "first").join(later, [*KEY, "pos"]), "line-pairs")
        ranks = _numbered(pairs, ["first", "second"], "line-ranks")
        level = stored(pairs.join(ranks, ["first", "second"]).select(*KEY, "pos", "rank"), "line-level")
        if level.isEmpty():
            return first.select(*KEY, "pos", "words"), levels
        levels.append(level)
        step *= 2


def shortest_runs(repeated: DataFrame, min_words: int) -> DataFrame:
    """(d, th, s, e): for each repeated line the shortest run of repeated lines [s, e) of at least
    ``min_words`` words that begins, and the one that ends, with it."""
    doc = Window.partitionBy(*KEY).orderBy("pos")
    run = Window.partitionBy(*KEY, "run")
    rows = (repeated.withColumn("run", F.col("pos") - F.row_number().over(doc))
            .withColumn("upto", F.sum("words").over(run.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("before", F.col("upto") - F.col("words")))
    none = F.lit(None).cast("int")

    def marks(at, mark, sought, asker):
        return rows.select(*KEY, "run", F.explode(F.array(
            F.struct(F.col(at).alias("at"), F.lit(0).alias("asks"), mark.alias("mark"), none.alias("asker")),
            F.struct(sought.alias("at"), F.lit(1).alias("asks"), none.alias("mark"), asker.alias("asker")))).alias("m")).select(*KEY, "run", "m.*")

    end, pos = F.col("pos") + 1, F.col("pos")
    ahead = marks("upto", end, F.col("before") + min_words, pos).withColumn("found", F.last("mark", True).over(
        run.orderBy(F.desc("at"), "asks", F.desc("mark")).rowsBetween(Window.unboundedPreceding, 0)))
    back = marks("before", pos, F.col("upto") - min_words, end).withColumn("found", F.last("mark", True).over(
        run.orderBy("at", "asks", "mark").rowsBetween(Window.unboundedPreceding, 0)))
    hit = "asks = 1 AND found IS NOT NULL"
    return (ahead.where(hit).select(*KEY, F.col("asker").alias("s"), F.col("found").alias("e"))
            .union(back.where(hit).select(*KEY, F.col("found").alias("s"), F.col("asker").alias("e"))).distinct())


def later_copies(runs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Those of the runs (d, th, s, e) that begin earlier somewhere with the same lines."""
    ranks = None
    for k, level in enumerate(levels):
        level = level.withColumn("k", F.lit(k))
        ranks = level if ranks is None else ranks.union(level)
    m = F.col("e") - F.col("s")
    sized = runs.withColumn("m", m).withColumn("k", F.floor(F.log2(m.cast("double"))).cast("int"))
    at = lambda name: ranks.select(*KEY, "k", F.col("pos").alias(f"p{name}"), F.col("rank").alias(name))
    named = (sized.withColumn("pa", F.col("s")).join(at("a"), [*KEY, "k", "pa"])
             .withColumn("pb", (F.col("e") - F.call_function("shiftleft", F.lit(1), F.col("k"))).cast("int")).join(at("b"), [*KEY, "k", "pb"])
             .select(*KEY, "s", "e", "m", "a", "b"))
    named = stored(named, "line-runs")
    earliest = (named.groupBy("m", "a", "b").agg(F.min(F.struct(*KEY, "s")).alias("least"), F.count("*").alias("n"))
                .where("n > 1").drop("n"))
    earliest = stored(earliest, "line-earliest")  # so the join stands alone in its stage and a hot interval can be split
    return named.join(earliest, ["m", "a", "b"]).where(F.struct(*KEY, "s") != F.col("least")).select(*KEY, "s", "e")


def merged(runs: DataFrame) -> DataFrame:
    """(d, th, deleted): each document's deleted lines as disjoint runs in order."""
    doc = Window.partitionBy(*KEY).orderBy("s", "e")
    begins = F.coalesce(F.col("s") > F.max("e").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return (runs.withColumn("begins", begins.cast("int"))
            .withColumn("island", F.sum("begins").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*KEY, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
            .groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("deleted")))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the later copies of repeated runs; ``deleted`` lists the runs [s, e)."""
    if min_words < 1:
        raise ValueError("min_words must be positive")
    lines = stored(line_table(docs, id_col, text_col), "lines")
    repeated, levels = suffix_levels(lines)
    gone = stored(merged(later_copies(shortest_runs(repeated, min_words), levels)), "line-deletions")
    # the input's row as one column: its names can't meet the helpers'
    whole = F.struct(*(F.col(c) for c in docs.columns if c not in ("n_lines", "n_deleted", "deleted")))
    rows = docs.select(whole.alias("row"), *_key(id_col, text_col)).join(gone.hint("shuffle_hash"), KEY, "left")
    runs = F.coalesce("deleted", F.from_json(F.lit("[]"), "array<struct<s:int,e:int>>"))

    def keep(ls: Column) -> Column:
        slices = F.zip_with(F.concat(F.array(F.lit(0)), F.transform("deleted", lambda r: r["e"])),
                            F.concat(F.transform("deleted", lambda r: r["s"]), F.array(F.size(ls))),
                            lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.array_join(F.flatten(F.transform(slices, lambda k: F.slice(ls, k["a"] + 1, k["b"] - k["a"]))), "\n")

    own = F.col("row")[text_col]
    text = F.when(F.col("deleted").isNull(), own).otherwise(F.transform(F.array(F.split(own, "\n", -1)), keep)[0])
    n_lines = F.when(own.isNull(), 0).otherwise(F.length(own) - F.length(F.replace(own, F.lit("\n"), F.lit(""))) + 1)
    n_deleted = F.aggregate(runs, F.lit(0), lambda n, r: n + r["e"] - r["s"])
    return rows.select(F.col("row").withField(text_col, text).alias("row"), n_lines.cast("long").alias("n_lines"),
                       n_deleted.cast("long").alias("n_deleted"), runs.alias("deleted")).select(
        "row.*", "n_lines", "n_deleted", "deleted")
