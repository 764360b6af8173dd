"""Operator 7, secret scans weighed by corpus-wide ownership.

Base spans are found by three patterns, leftmost and non-overlapping per kind. Besides, every run
of 20 or more key-like characters with a letter and a digit that lies in no base span is a
candidate. The digests of all values, base and candidate, are counted over the corpus by distinct
documents (repositories) and distinct sources (owners). Both decide: a value that ``example_owners``
or more owners hold in ``example_repositories`` or more documents is a widely copied example; any
other is owner-specific and looks live, be it in many documents of one or two owners or in few of
several. Candidates that are owner-specific are added as spans of kind ``key``; base spans always stay.

Positions are code points: a text split at a pattern gives the lengths between the matches, so
starts are running sums. Only rows in which a pattern occurs pay for that. Counting goes from
(digest, document, owner) to (digest, owner) to digest, each summed before its shuffle, so a value
in a third of all documents makes no hot task; what returns to the rows is joined as small rows
without text.

Defined cases: null text is empty and has no spans; a null source is an owner of its own; rows of
equal id and text share one result and count as one document; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import lit_str, running_sql
from reviewlake.operators.privacy import winning_sql

from .common import stored, text_or_empty

#: kind -> (pattern, group that holds the value, least characters of that group), in listed order
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (ASSIGN, 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
    "key": (r"[A-Za-z0-9+/_-]+", 0, 20),
}
#: a cheap pattern that any row with a span of the kind matches
SCREENS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}", "key": r"[A-Za-z0-9+/_-]{20}"}
#: the same matches with fewer failing ones, where the length alone decides
LONG = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}", "key": r"[A-Za-z0-9+/_-]{20,}"}
#: what the value of a kind must also hold
HOLDS = {"key": ("[0-9]", "[A-Za-z]")}
SPAN = "array<struct<start:int,place:int,kind:string,end:int,digest:string>>"


def spans(col: str, kind: str) -> Column:
    """All spans of a kind in the column ``col``, by start; linear but for the running sums, n log n."""
    pattern, group, least = KINDS[kind]
    pat, v = lit_str(LONG.get(kind, pattern)), "get(m.vals, i)"
    steps = "zip_with(slice(p.gaps, 1, size(p.hits)), p.hits, (g, h) -> length(g) + length(h))"
    parts = f"array(named_struct('gaps', split({col}, {pat}, -1), 'hits', regexp_extract_all({col}, {pat}, 0)))"
    found = (f"transform({parts}, p -> named_struct('hits', p.hits, 'ends', {running_sql(steps, '{a} + {b}')}, "
             f"'vals', {f'regexp_extract_all({col}, {pat}, {group})' if group else 'p.hits'}))")
    span = (f"named_struct('start', get(m.ends, i) - length(h), 'place', {list(KINDS).index(kind)}, 'kind', '{kind}', "
            f"'end', get(m.ends, i), 'digest', md5({v}))")
    also = "".join(f" AND {v} rlike {lit_str(x)}" for x in HOLDS.get(kind, ()))
    walked = (f"element_at(transform({found}, m -> filter(transform(m.hits, (h, i) -> CASE WHEN length({v}) >= {least}{also} "
              f"THEN {span} END), z -> z IS NOT NULL)), 1)")
    return F.expr(f"CASE WHEN {col} rlike {lit_str(SCREENS[kind])} THEN {walked} ELSE from_json('[]', '{SPAN}') END")


def outside(keys: str, base: str) -> Column:
    """The spans of column ``keys`` that lie within none of ``base``: of the base spans that start
    before a key's start + 1, none may end behind the key's end - 1. That is the question which the
    overlap sweep answers for a span (end - 1, start + 1)."""
    turned = f"transform({keys}, k -> named_struct('s', k.end - 1, 'e', k.start + 1, 'span', k))"
    return F.expr(f"""transform({winning_sql(turned, f"transform({base}, b -> named_struct('s', b.start, 'e', b.end))")}, x -> x.span)""")


def ownership(values: DataFrame) -> DataFrame:
    """(digest, repositories, owners) of rows (digest, d, th, owner)."""
    return (values.select("digest", "d", "th", "owner").distinct()
            .groupBy("digest", "owner").agg(F.count("*").alias("n"))
            .groupBy("digest").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners")))


def scan(docs: DataFrame, example_owners: int = 3, example_repositories: int = 5, id_col: str = "doc_id",
         text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Per document: ``base`` and ``added`` spans (arrays by start, then kind) and for each value
    whether it is an example."""
    text = text_or_empty(text_col)
    found = docs.select(F.col(id_col).alias("d"), F.xxhash64(text).alias("th"), F.col(owner_col).alias("owner"), text.alias("t"))
    found = found.select("d", "th", "owner", F.array_sort(F.concat(*(spans("t", k) for k in ("assign", "access", "hex")))).alias("base"),
                         spans("t", "key").alias("keys"))
    found = stored(found.select("d", "th", "owner", "base", outside("keys", "base").alias("keys")), "secret-spans")
    values = (found.where("size(base) + size(keys) > 0")
              .select("d", "th", "owner", F.explode(F.array_distinct(F.transform(F.concat("base", "keys"), lambda s: s["digest"]))).alias("digest"))
              .distinct())
    values = stored(values, "secret-values")
    examples = ownership(values).where((F.col("owners") >= example_owners) & (F.col("repositories") >= example_repositories)).select("digest")
    held = (values.select("d", "th", "digest").distinct().join(examples, "digest")
            .groupBy("d", "th").agg(F.collect_list("digest").alias("examples"))
            .select(F.col("d").alias("own_d"), F.col("th").alias("own_th"), "examples"))
    rows = found.join(held, F.col("d").eqNullSafe(F.col("own_d")) & (F.col("th") == F.col("own_th")), "left")
    example = lambda s: F.coalesce(F.array_contains("examples", s["digest"]), F.lit(False))
    return rows.select(F.col("d").alias("doc_id"), "base", F.filter("keys", lambda s: ~example(s)).alias("added"),
                       F.size(F.filter("base", example)).cast("long").alias("n_example"),
                       F.size(F.filter("base", lambda s: ~example(s))).cast("long").alias("n_live_base"))


def written(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def count_of(spans_: Column, kind: str) -> Column:
    return F.size(F.filter(spans_, lambda s: s["kind"] == kind)).cast("long")
