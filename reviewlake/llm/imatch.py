"""Operator 4, I-Match document fingerprints over randomised lexicon subsets.

The lexicon is the corpus's terms (lower-cased runs of letters, their marks and digits of any
script) whose document
frequency lies in a band: at least ``min_df`` documents (idf at most ln(N / min_df)) and at most
``max_share`` of them (idf at least ln(1 / max_share)). A signature is a hash of the sorted
distinct terms of a text that lie in one subset of the lexicon; a subset is a sample by hash, and
the fingerprint lists the signatures of several such subsets.

Each of up to eight families nests: its level l keeps a 2^-l part of the lexicon. A text uses three
levels, from the one that leaves it two to four of its terms on, so that a signature stands or
falls with few terms and the share of equal signatures measures how much two texts share, at
any length. Likeness is that share among the signatures that either text has, on the levels
that both use. A text without a term in any of its subsets is named by all its terms instead, and
is like only those with the same terms.

One departure from plain I-Match: a text with fewer than half of its sampled terms in the band (``SCARCE``:
one of a large near-copy group, whose own terms are above it, or of a corpus too small for a band) is
described by all its sampled terms, as it would otherwise be like nothing but its copies. Text and edited
text are each judged by their own terms alone, so equal texts have equal fingerprints on either side;
the share is as high as a half because an edited text may hold as many terms of another one.

Frequencies count distinct texts, so that copies move no term out of the band. A signature shows 40 bits of its hash. Only sampled (document, term) pairs are shuffled to meet the
band, at most a few dozen for a document of any length; common terms are no hot tasks, since pairs
are joined as plain rows whose skewed partitions Spark splits, and the grouping key afterwards is
the document. The edited texts need each document's successor: successors are found on rows of ids
by range partitions, whose ends are linked by one row per partition; the successor's head then
moves to its predecessor by an equi-join.

Defined cases: null text is empty; texts without terms are like each other; rows of equal id and
text are one document listed repeatedly, each gets the result; documents of equal id are ordered
by text hash, null ids come first; a single document follows itself; an empty table gives no rows;
other columns aren't read. Ids are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_methods, stored, text_or_empty

LEVELS = 3
LANE = 16  #: bits of a term's hash that one family has
SCARCE = 0.5  #: share of a text's sampled terms in the band below which all its terms describe it
NO_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(term_sets: DataFrame, min_df: int, max_share: float, n: int | None = None) -> DataFrame:
    """(term) in the band; ``term_sets`` has one array ``terms`` for each of ``n`` texts."""
    n = term_sets.count() if n is None else n
    df = term_sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= min_df) & (F.col("df") <= max(min_df, int(max_share * n)))).select("term")


def successors(ids: DataFrame) -> DataFrame:
    """``ids`` (distinct d, th, ...) with ``num``, a number in order, and the next row's num; the
    last is followed by the first."""
    ordered = stored(ids.repartitionByRange("d", "th").sortWithinPartitions("d", "th")
                     .withColumn("num", F.monotonically_increasing_id()), "imatch-order", "zstd")
    part = F.shiftright("num", 33).alias("part")  # the partition that numbered the row
    ends = ordered.groupBy(part).agg(F.min("num").alias("low"), F.max("num").alias("high"))
    every = Window.orderBy("low")  # one row per partition
    ends = ends.withColumn("after", F.coalesce(F.lead("low").over(every), F.first("low").over(every)))
    own = ordered.withColumn("next", F.col("num") + 1)
    return own.join(ends.select(F.col("high").alias("num"), "after"), "num", "left").withColumn(
        "next", F.coalesce("after", "next")).drop("after")


def _level(distinct: Column) -> Column:
    """First level of a text of so many terms: the highest that leaves two to four of them."""
    return F.least(F.lit(LANE - LEVELS), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(distinct, F.lit(1)) / 2.0)).cast("int")))


def _lanes(level: Column) -> Column:
    """The low ``level`` bits of each of a long's four 16-bit lanes."""
    low = F.call_function("shiftleft", F.lit(1).cast("long"), level) - F.lit(1).cast("long")
    return low.bitwiseOR(F.shiftleft(low, 16)).bitwiseOR(F.shiftleft(low, 32)).bitwiseOR(F.shiftleft(low, 48))


def _zero_lanes(v: Column) -> Column:
    """1 in the lowest bit of each lane that is zero."""
    ones = F.lit(0x0001000100010001)
    for by in (8, 4, 2, 1):
        v = v.bitwiseOR(F.shiftrightunsigned(v, by))
    return v.bitwiseAND(ones).bitwiseXOR(ones)


def _picked(rows: DataFrame) -> DataFrame:
    """One row per sampled (document, term) with the families that keep it, and one row (term
    null) per document with what it keeps.

    Family f's level l keeps the terms of whose hash lane f ends in l zeros: lanes 0-3 of the
    term's hash, 4-7 of a second hash. ``bits`` has, for lane k of hash h and the text (side 0) or the
    edited text (side 1), bit 16 k + 2 h + side."""
    kept = ["num", "next", "d", "copies", "n_chars", "edited_sha256", "level", "edited_level", "all_terms", "edited_terms"]
    sets = rows.select(*kept, _lanes(F.col("level")).alias("m0"), _lanes(F.col("edited_level")).alias("m1"),
                       F.array_intersect("o", "e").alias("both"), F.array_except("o", "e").alias("left"),
                       F.array_except("e", "o").alias("gained"))
    out = sets.select(*kept, "m0", "m1", F.size("both").alias("n_both"), F.size("left").alias("n_left"), F.posexplode(
        F.concat(F.array(F.lit(None).cast("long")), "both", "left", "gained")).alias("at", "term"))
    which = F.when(F.col("at") <= F.col("n_both"), 3).when(F.col("at") <= F.col("n_both") + F.col("n_left"), 1).otherwise(2)
    out = out.select(*kept, "m0", "m1", "term", which.alias("which"), F.xxhash64("term").alias("second"))
    bits = F.lit(0).cast("long")
    for side in (0, 1):
        here = F.when(F.col("which").bitwiseAND(F.lit(1 << side)) != 0, F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long"))
        for h, hashed in enumerate(("term", "second")):
            zero = _zero_lanes(F.col(hashed).bitwiseAND(F.col(f"m{side}")))
            bits = bits.bitwiseOR(F.shiftleft(zero, 2 * h + side).bitwiseAND(here))
    first = F.col("term").isNull()
    out = out.withColumn("bits", F.when(first, 0).otherwise(bits)).where(first | (F.col("bits") != 0)).drop("which", "m0", "m1", "second")
    return out.select("num", "term", "bits", *(F.when(first, F.col(c)).alias(c) for c in kept[1:]))


def _signatures(picks: str, level: str, whole: str, families: int, side: int) -> Column:
    """The fingerprint: its level, then family.level.hash of every subset that holds a term."""
    def subset(family: int, step: int) -> Column:
        lane, second = family % 4, family // 4
        ours = F.lit(1 << (16 * lane + 2 * second + side))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(level) + step) - F.lit(1).cast("long")

        def kept(p: Column) -> Column:
            hashed = F.xxhash64(p["term"]) if second else p["term"]
            return (p["bits"].bitwiseAND(ours) != 0) & (F.shiftrightunsigned(hashed, 16 * lane).bitwiseAND(low) == 0)
        return F.array_sort(F.transform(F.filter(picks, kept), lambda p: p["term"]))

    entries = []
    for f in range(families):
        for j in range(LEVELS):
            own = subset(f, j)
            entries.append(F.when(F.size(own) > 0, F.concat(
                F.lit(f"{f}."), (F.col(level) + j).cast("string"), F.lit("."),
                F.lower(F.substring(F.lpad(F.hex(F.xxhash64(own)), 16, "0"), 1, 10)))))
    found = F.array_compact(F.array(*entries))
    return F.concat(F.lit("L"), F.col(level).cast("string"), F.lit(","),
                    F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise(F.concat(F.lit("all."), F.lower(F.hex(whole)))))


def _described(picks: str, side: int) -> Column:
    """The sampled terms that describe the text (side 0) or the edited text (side 1): those in the
    band, or all where these are scarce. Decided by that side's terms alone."""
    own = F.filter(picks, lambda p: p["bits"].bitwiseAND(F.lit(0x0005000500050005 << side)) != 0)
    known = F.filter(own, lambda p: p["known"])
    return F.when(F.size(known) < F.size(own) * SCARCE, own).otherwise(known)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among those that either fingerprint has on common levels."""
    level = lambda x: F.regexp_extract(x, "^L([0-9]+)", 1).cast("int")
    low, high = F.greatest(level(a), level(b)), F.least(level(a), level(b)) + (LEVELS - 1)
    on = lambda x: F.filter(F.slice(F.split(x, ","), 2, 1000), lambda s: ~s.startswith("all.") & (
        F.split(s, r"\.")[1].cast("int").between(low, high)))
    named = lambda x: F.transform(on(x), lambda s: F.substring_index(s, ".", 2))
    either = F.size(F.array_union(named(a), named(b)))
    return F.when(a == b, 1.0).when(either > 0, F.size(F.array_intersect(on(a), on(b))) / either).otherwise(0.0)


def fingerprints(docs: DataFrame, families: int = 8, min_df: int = 2, max_share: float = 0.05, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text (the second half replaced by the
    successor's beginning), and its likeness to that and to the successor's."""
    if not 1 <= families <= 8:
        raise ValueError("there are lanes for one to eight families")
    text = text_or_empty(text_col)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("t"))
    ids = keyed.groupBy("d", "th").agg(F.count("*").alias("copies"), F.max(F.char_length("t")).alias("n_chars"))
    order = stored(successors(ids), "imatch-next", "zstd")
    before = order.select(F.col("next").alias("num"), F.col("num").alias("prev"), F.col("n_chars").alias("prev_chars"),
                          F.col("d").alias("prev_d"), F.col("th").alias("prev_th"))
    links = stored(order.join(before, "num"), "imatch-links", "zstd")
    texts = (keyed.withColumn("n", F.row_number().over(Window.partitionBy("d", "th").orderBy("th")))
             .where("n = 1").drop("n"))
    own = texts.join(links.select("d", "th", "num", "next", "copies", "n_chars").hint("shuffle_hash"), ["d", "th"])
    heads = (texts.join(links.select("d", "th", "prev_d", "prev_th", "prev_chars").hint("shuffle_hash"), ["d", "th"])
             .select(F.col("prev_d").alias("d"), F.col("prev_th").alias("th"),
                     F.substring(F.col("t"), F.lit(1), F.floor(F.col("prev_chars") / 2).cast("int")).alias("head")))
    edited = F.concat(F.substring(F.col("t"), F.lit(1), F.col("n_chars") - F.floor(F.col("n_chars") / 2).cast("int")), F.col("head"))
    both = (own.join(heads.hint("shuffle_hash"), ["d", "th"]).withColumn("x", edited)
            .select("num", "next", "d", "copies", "n_chars", F.sha2("x", 256).alias("edited_sha256"),
                    terms(F.col("t")).alias("o"), terms(F.col("x")).alias("e"))
            .withColumn("level", _level(F.size("o"))).withColumn("edited_level", _level(F.size("e")))
            .withColumn("all_terms", F.xxhash64(F.array_sort("o"))).withColumn("edited_terms", F.xxhash64(F.array_sort("e"))))
    with small_methods(docs.sparkSession):
        rows = stored(_picked(both), "imatch-picks", "zstd")
    firsts = order.groupBy("th").agg(F.min("d").alias("d"))  # one document of each text
    band = lexicon(texts.join(firsts, ["d", "th"], "left_semi").select(terms(F.col("t")).alias("terms")),
                   min_df, max_share, firsts.count())
    known = F.col("known").isNotNull().alias("known")
    picks = (rows.where("term IS NOT NULL").select("num", "term", "bits")
             .join(band.withColumn("known", F.lit(True)), "term", "left").select("num", F.struct("term", "bits", known).alias("pick"))
             .groupBy("num").agg(F.collect_list("pick").alias("picks"))
             .select("num", _described("picks", 0).alias("own_picks"), _described("picks", 1).alias("edited_picks")))
    none = F.from_json(F.lit("[]"), "array<struct<term:bigint,bits:bigint,known:boolean>>")
    signed = (rows.where("term IS NULL").drop("term", "bits").join(picks, "num", "left")
              .withColumn("own_picks", F.coalesce("own_picks", none)).withColumn("edited_picks", F.coalesce("edited_picks", none))
              .select("num", "next", "d", "copies", "n_chars", "edited_sha256",
                      _signatures("own_picks", "level", "all_terms", families, 0).alias("fingerprint"),
                      _signatures("edited_picks", "edited_level", "edited_terms", families, 1).alias("edited_fingerprint")))
    with small_methods(docs.sparkSession):
        signed = stored(signed, "imatch-signatures", "zstd")
    after = signed.select(F.col("num").alias("next"), F.col("fingerprint").alias("next_fingerprint"))
    return (signed.join(after, "next")
            .select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"),
                    "edited_sha256", "fingerprint", "edited_fingerprint",
                    likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                    likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
                    F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy"))
