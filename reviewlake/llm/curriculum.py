"""Operator 5, mixing sources to target weights along a time-varying curriculum.

Targets: source i (in order of its name by code point, null last) weighs ``weights[i mod len]``;
the sources share ``total`` times all words, no source more than ``most`` times its own, and what
a full source leaves is shared again by weight until none is above. Solved exactly in rounds over
one row per source: each round shares the rest among the open sources and closes those above.

Positions: over training time 0..1 a source's sampling weight follows a schedule, given by its
values at equally spaced knots and linear between them; its integral is the share of its target
that is due by then. A source's documents queue in order of a hash of their ids and texts, once per
pass, up to the target; the document that begins at word u of the queue gets the time at which u words are
due, the inverse of the integral: a root of a quadratic within one segment. The mix is range-sorted
by that time.

The queue is a running sum over all documents of a source, however large the source: documents are
dealt into hash buckets, each (source, bucket) sums its words before the shuffle, the buckets'
offsets are a running sum over one row per bucket, and only inside a bucket entries are ordered. An
entry is all rows of equal id, source and text in one part of the written table, so a row repeated
in a third of all rows is one entry per part, and its copies are numbered part by part. Texts go to
their passes by a row number that is written with them, which no two rows share.

The last document that a source needs is cut at a word, so a source takes its target to the word.

Defined cases: null text has size 0; size-0 documents take nothing; a null source is a source of
its own, last in order; rows of equal id are all documents (rows of equal id, source and text are
interchangeable); null ids queue by their texts' hashes; an empty table gives no rows; other columns are
kept, and the operator's own result columns replace columns of their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
#: sampling weight at time 0, 1/2, 1, dealt to the sources in turn: falling, rising, level
SCHEDULES = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))
OWN = ("size", "source_size", "target", "taken", "position", "again")


def sizes(docs: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(per_source: DataFrame, weights=(3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` with ``place`` (from 0), ``weight`` and ``target``. One row per
    source; each round is one sum over them."""
    spark = per_source.sparkSession
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = stored(per_source.withColumn("place", (F.row_number().over(order) - 1).cast("long"))
                  .withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                                                     (F.col("place") % len(weights) + 1).cast("int"))), "mix-sources")
    cap, level = F.col("source_size") * F.lit(float(most)), float("inf")
    want = (rows.agg(F.sum("source_size").alias("s")).first()["s"] or 0) * total
    while True:  # the level rises until no more source closes
        full = F.col("weight") * F.lit(level) > cap if level != float("inf") else F.lit(False)
        r = rows.agg(F.sum(F.when(full, cap)).alias("closed"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        new = (want - (r["closed"] or 0.0)) / r["open"]
        if new == level or (level != float("inf") and new < level):
            break
        level = new
    target = F.least(cap, F.col("weight") * F.lit(level)) if level != float("inf") else cap
    return rows.withColumn("target", target.cast("double"))


def due(schedule: tuple, share: Column) -> Column:
    """The time at which ``share`` (0..1) of a source's words are due: the inverse of the
    schedule's integral over its own total."""
    step = 1.0 / (len(schedule) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, before, out = sum(areas), 0.0, F.lit(1.0)
    parts = []
    for k, (a, b) in enumerate(zip(schedule, schedule[1:], strict=False)):
        rest = share * whole - before  # area into this segment
        slope = (b - a) / step
        into = (rest / a) if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0))) - a) / slope
        before += areas[k]
        parts.append((share * whole <= before, F.lit(k * step) + into))
    for test, value in reversed(parts):
        out = F.when(test, value).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def _numbered(docs: DataFrame, kept: list[str], id_col: str, text_col: str, compression: str | None = None) -> DataFrame:
    """A written table of each document's ``row`` (its ``kept`` columns, which no name here can clash
    with), a number ``uid`` of its own, ``id``, ``source``, ``size``, hash ``h`` and text hash ``th``."""
    th = F.xxhash64(F.col(text_col))
    return stored(docs.select(
        F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
        F.col("source").alias("source"), sizes(docs, text_col).alias("size"), F.xxhash64(F.lit("mix"), F.col(id_col), th).alias("h"),
        th.alias("th")), "mix-rows", compression)


def _planned(sized: DataFrame, columns: list[str], weights, total: float, most: float, schedules) -> DataFrame:
    """The plan of a numbered table: its ``columns`` and the plan's own."""
    if most > 2:
        raise ValueError("a document is passed twice at most")
    buckets = 2 * math.isqrt(sized.count()) + 1  # as many buckets as rows in one, within a factor
    bucket = F.floor((F.shiftrightunsigned("h", 33) * F.lit(buckets)) / F.lit(1 << 31))
    per_bucket = stored(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "mix-buckets")
    offsets = per_bucket.withColumn("offset", F.coalesce(F.sum("words").over(
        Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("words")
    aims = targets(per_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total, most)
    heads = (offsets.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
             .withColumnRenamed("source", "s").withColumnRenamed("bucket", "b"))
    # rows alike in id, source and text queue as one entry per part of the written table (the upper bits of uid);
    # the entry's key is a struct, whose fields may be null and still be equal
    alike = F.struct("source", "id", "th", "size", F.shiftright("uid", 33).alias("part"))
    entries = sized.groupBy(alike.alias("k")).agg(F.first("h").alias("h"), F.sum("size").alias("words"))
    inside = Window.partitionBy("k.source", "bucket").orderBy("h", "k").rowsBetween(Window.unboundedPreceding, -1)
    queued = (entries.withColumn("bucket", bucket).withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0)))
              .join(heads, F.col("k.source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
              .select("k", (F.col("offset") + F.col("inside")).alias("entry"), "source_size", "target", "place",
                      F.round("target").cast("long").alias("aim")))
    copy = F.row_number().over(Window.partitionBy("k").orderBy("uid")) - 1
    rows = (sized.select(*columns, *(c for c in ("uid", "size") if c not in columns), alike.alias("k")).withColumn("copy", copy).join(queued, "k")
            .withColumn("begin", F.col("entry") + F.col("copy") * F.col("size")))
    got = lambda skip: F.greatest(F.lit(0), F.least(F.col("size"), F.col("aim") - F.col("begin") - skip)).cast("long")

    def when_due(begin):
        share = begin / F.col("aim")
        out = due(schedules[-1], share)
        for k, s in enumerate(schedules[:-1]):
            out = F.when(F.col("place") % len(schedules) == k, due(s, share)).otherwise(out)
        return out

    second = F.col("begin") + F.col("source_size")
    return rows.select(
        *columns, "size", "source_size", "target", (got(F.lit(0)) + got(F.col("source_size"))).alias("taken"),
        F.when(got(F.lit(0)) > 0, when_due(F.col("begin"))).alias("position"),
        F.when(got(F.col("source_size")) > 0, when_due(second)).alias("again"))


def plan(docs: DataFrame, weights=(3, 1, 2), total: float = 1.5, most: float = 2.0, schedules=SCHEDULES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document (without its text; columns named like the plan's own are replaced) with ``size``,
    ``source_size``, ``target``, ``taken`` and the times of its first and second pass, ``position`` and
    ``again`` (null: not taken then)."""
    kept = [c for c in docs.columns if c.lower() not in OWN and c != text_col]
    planned = _planned(_numbered(docs, kept, id_col, text_col), ["row"], weights, total, most, schedules)
    return planned.select(*(F.col("row").getField(c).alias(c) for c in kept), *OWN)


def by_position(planned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The plan, range-sorted by time; what the mix leaves out stands last, by id, so that it too
    is dealt over many ranges."""
    return planned.orderBy(F.col("position").asc_nulls_last(), F.col(id_col))


def mix(docs: DataFrame, weights=(3, 1, 2), total: float = 1.5, most: float = 2.0, schedules=SCHEDULES,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed training set: the columns of ``docs``, one row per document and pass, in order of
    time; the last document that a source needs is cut after its last word taken."""
    rows = _numbered(docs, docs.columns, id_col, text_col, "zstd")
    passes = (_planned(rows, ["uid"], weights, total, most, schedules).where("taken > 0")
              .select("uid", F.col("size").alias("words"), F.explode(F.filter(F.array(
                  F.struct(F.col("position").alias("at"), F.least("size", "taken").alias("words")),
                  F.struct(F.col("again").alias("at"), (F.col("taken") - F.col("size")).alias("words"))),
                  lambda p: p["at"].isNotNull() & (p["words"] > 0))).alias("pass")))
    own = F.col("row")[text_col]
    cut = F.concat_ws("", F.slice(F.split(own, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1),
                                  F.col("pass.words").cast("int")))
    text = F.when(F.col("pass.words") < F.col("words"), cut).otherwise(own)
    taken = (rows.select("uid", "row").join(passes, "uid")
             .select(F.col("row").withField(text_col, text).alias("row"), F.col("pass.at").alias("at")))
    return taken.orderBy("at").select("row.*")
