"""Privacy and secret operators.

Masking is map-side: chained ``regexp_replace`` (and a validated replace for Luhn /
mod-97 entities) on one column, no shuffle. The order is fixed: cap first (done by
the diff guardrail), then entities in priority order, then the three secret patterns.
The same operators run on any text column (documents, pages, conversations).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import count_matches, count_validated, lit_str, part_sql, running_sql, validated_replace_sql

_PEM_GUARD = "-----BEGIN"


def entity_label(name: str) -> str:
    return f"<{name}>"


def _entity_list(entities):
    wanted = [e for e, _ in P.ENTITY_PATTERNS] if entities is None else list(entities)
    return [(e, P.java_pattern(p)) for e, p in P.ENTITY_PATTERNS if e in wanted]


_SENTINEL = "\ue000"  # private-use character standing in for one match while counting


def guard_sql(col_sql: str, name: str) -> str:
    """SQL predicate that must hold for ``name`` to match (``true`` when none is known)."""
    g = P.ENTITY_GUARDS.get(name)
    if g is None:
        return "true"
    kind, val = g
    return f"contains({col_sql}, {lit_str(val)})" if kind == "contains" else f"({col_sql} rlike {lit_str(val)})"


def _mask_line_sql(name: str, pattern: str) -> str:
    """SQL: the line ``ml`` with one entity masked (validated entities only when the check holds); a line
    that fails the entity's cheap guard is passed through untouched."""
    check = P.VALIDATED_ENTITIES.get(name)
    if check:
        masked = validated_replace_sql("ml", pattern, entity_label(name), check)
    else:
        masked = f"regexp_replace(ml, {lit_str(pattern)}, {lit_str(entity_label(name))})"
    return f"CASE WHEN {guard_sql('ml', name)} THEN {masked} ELSE ml END"


def mask_entity_col(col_sql: str, name: str, pattern: str) -> Column:
    """Mask one entity in column ``col_sql``; rows failing the entity's cheap guard are passed through
    untouched. No entity spans lines, so of the other rows only the lines that pass the guard meet the
    whole pattern."""
    return F.expr(f"CASE WHEN {guard_sql(col_sql, name)} THEN array_join(transform(split({col_sql}, '\\n', -1), "
                  f"ml -> {_mask_line_sql(name, pattern)}), '\\n') ELSE {col_sql} END")


def mask_entities_sql(col_sql: str, entities) -> str:
    """SQL: ``col_sql`` with all of ``entities`` (names with patterns, in priority order) masked. The text
    is split into lines once; a line without a digit or an ``@`` holds no entity, the others go from
    entity to entity."""
    line = "array(al)"
    for name, pattern in entities:
        line = f"transform({line}, ml -> {_mask_line_sql(name, pattern)})"
    return (f"array_join(transform(split({col_sql}, '\\n', -1), al -> "
            f"CASE WHEN al rlike {lit_str(P.ENTITY_SIGNS)} THEN element_at({line}, 1) ELSE al END), '\\n')")


def mask_entities(df: DataFrame, col: str, entities=None, out: str | None = None) -> DataFrame:
    """Replace e-mails, IBANs, Luhn-valid cards, wallets, SSNs, IPs and phone
    numbers by ``<ENTITY>`` labels, in that priority order (a card is masked before a
    phone pattern can see its digits)."""
    wanted = _entity_list(entities)
    masked = F.expr(mask_entities_sql(f"`{col}`", wanted)) if wanted else F.col(col)
    return df.withColumn(out or col, masked)


def counted_replace(df: DataFrame, col: str, pattern: str, label: str, count: str, out: str, guard: Column | None = None) -> DataFrame:
    """Replace the matches of ``pattern`` and count them (BIGINT) in one regex pass: matches become a
    sentinel character, counted by length difference, then swapped for the label. Texts that already
    hold the sentinel take the two-pass path; rows without ``guard`` have no match."""
    t, m = F.col(col), F.col("__marked")
    guard = F.lit(True) if guard is None else guard
    safe = ~t.contains(_SENTINEL)
    df = df.withColumn("__marked", F.when(guard & safe, F.regexp_replace(t, pattern, _SENTINEL)))
    n = F.when(~guard, F.lit(0)).when(safe, F.length(m) - F.length(F.replace(m, F.lit(_SENTINEL), F.lit("")))).otherwise(count_matches(t, pattern))
    masked = F.when(~guard, t).when(safe, F.replace(m, F.lit(_SENTINEL), F.lit(label))).otherwise(F.regexp_replace(t, pattern, label))
    return df.withColumns({count: n.cast("bigint"), out: masked}).drop("__marked")


def entity_counts(df: DataFrame, col: str, key: str, entities=None, masked: str | None = None, keep=()) -> DataFrame:
    """Per row: how many spans of each entity the priority-ordered masking replaces.

    Each entity is counted on the text where higher-priority entities are already
    masked, so a span is counted once, under its winning entity. BIGINT counts named
    ``n_<entity lower>``. ``masked`` names a column for the masked text that the counting
    makes anyway; ``keep`` lists columns to carry along.
    """
    tmp = "__ec_text"
    df = df.select(key, *keep, F.col(col).alias(tmp))
    counts = []
    for name, pat in _entity_list(entities):
        cname = f"n_{name.lower()}"
        check = P.VALIDATED_ENTITIES.get(name)
        guard = F.expr(guard_sql(tmp, name))
        if check:
            df = df.withColumn(cname, F.when(guard, count_validated(tmp, pat, check)).otherwise(F.lit(0))
                               .cast("bigint")).withColumn(tmp, mask_entity_col(tmp, name, pat))
        else:
            df = counted_replace(df, tmp, pat, entity_label(name), cname, tmp, guard)
        counts.append(cname)
    return df.select(key, *keep, *counts, *([F.col(tmp).alias(masked)] if masked else []))


SPANS_TYPE = "array<struct<s:int,e:int>>"


def _spans_expr(col_sql: str, name: str, pattern: str) -> str:
    """SQL: array<struct<s, e>> of one entity's matches (0-based, end excl.), in order.

    A hit ends where the lengths of all pieces and hits up to it sum up to.
    """
    pat = lit_str(pattern)
    check = P.VALIDATED_ENTITIES.get(name)
    part = part_sql("h", check) if check else "h"
    steps = "zip_with(slice(m.gaps, 1, size(m.hits)), m.hits, (g, h) -> length(g) + length(h))"
    spans = (f"zip_with({running_sql(steps, '{a} + {b}')}, m.hits, (z, h) -> named_struct('s', z - length(h), "
             f"'e', z - length(h) + length({part})))")
    return (f"element_at(transform(array(named_struct('gaps', split({col_sql}, {pat}, -1), 'hits', regexp_extract_all({col_sql}, {pat}, 0))), "
            f"m -> filter({spans}, z -> z.e IS NOT NULL)), 1)")


def winning_sql(own: str, better: str) -> str:
    """SQL: the spans of ``own`` that overlap none of ``better`` (arrays of struct<s, e>).

    The better spans are swept in the order of their starts with the farthest end so far; a span is
    lost if that end, among those that start before its own end (found by halving), is behind its start.
    """
    ends = running_sql("t.by_start.e", "greatest({a}, {b})")
    mid = "cast((b.lo + b.hi) div 2 AS int)"
    before = (f"aggregate(sequence(0, cast(ceil(log2(size(w.s) + 1)) AS int)), named_struct('lo', 0, 'hi', size(w.s)), (b, k) -> "
              f"CASE WHEN b.lo >= b.hi THEN b WHEN get(w.s, {mid}) < a.e THEN named_struct('lo', {mid} + 1, 'hi', b.hi) "
              f"ELSE named_struct('lo', b.lo, 'hi', {mid}) END).lo")
    kept = f"filter({own}, a -> NOT coalesce(get(w.ends, {before} - 1) > a.s, false))"
    swept = (f"element_at(transform(transform(array(named_struct('by_start', array_sort({better}))), t -> named_struct("
             f"'s', t.by_start.s, 'ends', {ends})), w -> {kept}), 1)")
    return f"CASE WHEN size({own}) = 0 OR size({better}) = 0 THEN {own} ELSE {swept} END"


def entity_spans(df: DataFrame, col: str, key: str, entities=None) -> DataFrame:
    """One row per winning entity span ``(key, entity, start, end)``.

    Spans of all entities are found on the original text; a span is dropped when an
    overlapping span has a better (priority, longer, earlier) rank. Spans of one entity never
    overlap, so the priority decides, and each entity's spans are held against those of
    all better ones. This works on the row's own arrays, n log n, so it needs no
    self-join or shuffle. Matched text is never emitted.
    """
    ents = _entity_list(entities)
    x = df.select(key, F.col(col).alias("__text"))
    for name, p in ents:
        found = f"CASE WHEN {guard_sql('__text', name)} AND __text rlike {lit_str(p)} THEN {_spans_expr('__text', name, p)} END"
        x = x.withColumn(f"__{name}", F.expr(f"coalesce({found}, cast(array() AS {SPANS_TYPE}))"))
    won = []
    for k, (name, _) in enumerate(ents):
        better = f"concat({', '.join(f'__{n}' for n, _ in ents[:k])})" if k else f"cast(array() AS {SPANS_TYPE})"
        won.append(f"transform({winning_sql(f'__{name}', better)}, a -> named_struct('entity', '{name}', 's', a.s, 'e', a.e))")
    x = x.select(key, F.explode(F.expr(f"concat({', '.join(won)})")).alias("sp"))
    return x.select(key, F.col("sp.entity").alias("entity"), F.col("sp.s").cast("bigint").alias("start"),
                    F.col("sp.e").cast("bigint").alias("end"))


def person_names(spark: SparkSession, names=None) -> DataFrame:
    """The name dictionary as a one-column table ``name``."""
    names = names or P.DEFAULT_PERSON_NAMES
    return spark.createDataFrame([(n,) for n in names], "name string")


#: characters of a dictionary up to which it goes into the plan as one pattern
MAX_PATTERN_NAMES = 200_000
_LETTER = r"[\p{L}\p{M}\p{N}_]"
_GAP = r"[^\S\r\n]+"
PERSON_LABEL = "<PERSON>"


def name_trie(names) -> str:
    """One pattern for all names: a trie of their characters, so that a text's character is looked
    at once whatever the number of names. Each name's continuation comes before its own end, and
    the match must end at a word's end: the longest name wins. Blanks of a name match any run of
    blanks within the line."""
    root: dict = {}
    for name in names:
        node = root
        for c in name:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        more = sorted(c for c in node if c)
        if not more:
            return ""
        branches = "|".join((_GAP if c == " " else re.escape(c)) + written(node[c]) for c in more)
        return f"(?:{branches})" + ("?" if "" in node else "") if len(more) > 1 or "" in node else branches
    return f"(?<!{_LETTER}){written(root)}(?!{_LETTER})"


def _plain_names(names: DataFrame) -> DataFrame:
    """Distinct names with single blanks; empty ones name nobody."""
    name = F.trim(F.regexp_replace(F.col("name"), r"(?U)\s+", " "))
    return names.select(name.alias("name")).where("name <> ''").distinct()


def mask_persons(df: DataFrame, col: str, key: str, names: DataFrame, max_pattern: int = MAX_PATTERN_NAMES) -> DataFrame:
    """Replace dictionary names, of one word or several, with ``<PERSON>``; the longest name at a
    place wins.

    A dictionary of up to ``max_pattern`` characters (counted first) becomes one trie pattern, and
    each text is masked in its row: no key, no join, no shuffle. A larger one is joined to the
    distinct word runs of each text by the text's digest (so null or repeated ``key`` values
    change nothing), and each text is masked by a pattern of the names it may hold.
    """
    names = _plain_names(names)
    size = names.agg(F.sum(F.length("name"))).first()[0] or 0
    if not size:
        return df
    if size <= max_pattern:
        pattern = name_trie(r.name for r in names.collect())
        return df.withColumn(col, F.regexp_replace(F.col(col), pattern, PERSON_LABEL))

    def words(c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit(f"{_LETTER}+"), F.lit(0))
    named = names.select("name", F.array_join(words(F.col("name")), " ").alias("__run"), F.size(words(F.col("name"))).alias("__n"))
    most = named.agg(F.max("__n")).first()[0]
    runs = F.array_distinct(F.flatten(F.array(*(F.expr(
        f"CASE WHEN size(__w) >= {n} THEN transform(sequence(1, size(__w) - {n - 1}), i -> array_join(slice(__w, i, {n}), ' ')) "
        "ELSE cast(array() AS array<string>) END") for n in range(1, most + 1)))))
    escaped = F.replace(F.regexp_replace("name", r"([\\\[\](){}.*+?^$|])", r"\\$1"), F.lit(" "), F.lit(_GAP))
    x = df.withColumn("__text", F.xxhash64(F.col(col)))
    found = (x.select("__text", words(F.col(col)).alias("__w")).select("__text", F.explode(runs).alias("__run")).distinct()
             .join(named, "__run").groupBy("__text")
             .agg(F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("n"), escaped.alias("p")))).alias("__names")))
    own = F.concat(F.lit(f"(?<!{_LETTER})(?:"), F.array_join(F.col("__names.p"), "|"), F.lit(f")(?!{_LETTER})"))
    masked = F.when(F.col("__names").isNull(), F.col(col)).otherwise(F.regexp_replace(F.col(col), own, F.lit(PERSON_LABEL)))
    return x.join(found, "__text", "left").select(*(masked.alias(c) if c == col else F.col(c) for c in df.columns))


def _holds(c: Column, words) -> Column:
    """Does the text hold any of the words?"""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def mask_secrets_col(c: Column) -> Column:
    """C10-C12 on one column: PEM blocks, AWS key ids, secret assignments.

    PEM runs with DOTALL; the rare patterns are guarded by a cheap ``contains`` on the column
    itself (no label makes a text hold what it did not).
    """
    pem = F.when(c.contains(_PEM_GUARD), F.regexp_replace(c, "(?s)" + P.PEM_PATTERN, P.PEM_LABEL)).otherwise(c)
    aws = F.when(_holds(c, P.AWS_KEY_BEGINS), F.regexp_replace(pem, P.AWS_KEY_SEARCH, P.AWS_KEY_LABEL)).otherwise(pem)
    # (?U): \\s and case folding are Unicode, as in the Python service (Java's are ASCII).
    named = F.transform(F.array(F.lower(c)), lambda t: _holds(t, P.SECRET_WORDS))[0] | _holds(c, P.FOLDED_LETTERS)
    return F.when(named, F.regexp_replace(aws, P.SECRET_ASSIGN_SEARCH, P.SECRET_LABEL)).otherwise(aws)


def mask_secrets(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, mask_secrets_col(F.col(col)))


def sanitize(df: DataFrame, diff_col: str = "capped_diff", out: str = "sanitized_diff",
             entities=None) -> DataFrame:
    """Entities then secrets on the capped diff; empty stays empty, and a row whose
    masking produced nothing gets the failure sentinel, never the raw text."""
    masked = mask_entities(df, diff_col, entities, out="__san")
    masked = mask_secrets(masked, "__san")
    src = F.col(diff_col)
    return masked.withColumn(out, F.when(src.isNull() | (src == ""), F.coalesce(src, F.lit("")))
                             .otherwise(F.coalesce(F.col("__san"), F.lit(P.PRIVACY_FAILURE_TEXT)))).drop("__san")


# ---------------------------------------------------------------------------
# Deterministic secret scan
# ---------------------------------------------------------------------------

# Our rule table (stand-in for external scanners): (rule_id, tool, severity, pattern).
SECRET_RULES = [
    ("private-key", "Gitleaks", "CRITICAL", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws-access-key-id", "Gitleaks", "CRITICAL", r"(AKIA|AGPA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}"),
    ("generic-secret-assignment", "Gitleaks", "HIGH",
     r"""(?i)(password|passwd|secret|token|api_key|apikey)\s*[:=]\s*["']?[^\s"']{6,}"""),
    ("github-token", "Gitleaks", "HIGH", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("slack-token", "Gitleaks", "HIGH", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("jwt", "Gitleaks", "MEDIUM", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("curl-pipe-shell", "Trivy", "HIGH", r"(?i)curl[^|]*\|\s*(ba)?sh"),
    ("world-writable-chmod", "Trivy", "HIGH", r"chmod\s+(-R\s+)?777"),
    ("tls-verify-disabled", "Trivy", "HIGH", r"(?i)verify\s*=\s*False|ssl_verify\s*[:=]\s*false"),
    ("docker-latest-tag", "Trivy", "MEDIUM", r"(?i)^\s*FROM\s+[^\s:]+:latest"),
]
TOOL_ORDER = ["Gitleaks", "Trivy"]

#: by rule: one of these words is in every text that holds a hit (in any case, if the rule ignores it)
RULE_WORDS = {
    "private-key": ["PRIVATE KEY-----"],
    "aws-access-key-id": P.AWS_KEY_BEGINS,
    "generic-secret-assignment": P.SECRET_WORDS,
    "github-token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "slack-token": ["xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"],
    "jwt": ["eyJ"],
    "curl-pipe-shell": ["curl"],
    "world-writable-chmod": ["chmod"],
    "tls-verify-disabled": ["verify"],
    "docker-latest-tag": [":latest"],
}
SECRET_WORDS = {p: RULE_WORDS[r] for r, _, _, p in SECRET_RULES}


def secret_findings(lines: DataFrame, rules=None) -> DataFrame:
    """C14: rule hits on raw diff lines -> ``pr_id, tool, rule_id, severity, path, line``.

    Every rule becomes one ``when(rlike)`` inside a single array per line, so each line
    is read once and only hits are exploded (no lines x rules product). Output carries
    rule, file and line, never the matched text.
    """
    rules = rules or SECRET_RULES
    body = lines.filter(F.col("sign").isin("+", "-", " "))

    def hits_of(lower: Column) -> Column:
        found = []
        for r, t, s, p in rules:
            hit = F.col("text").rlike(p)
            if p in SECRET_WORDS:  # a line without the rule's words is not held against its pattern
                hit = _holds(lower if p.startswith("(?i)") else F.col("text"), SECRET_WORDS[p]) & hit
            found.append(F.when(hit, F.struct(F.lit(r).alias("rule_id"), F.lit(t).alias("tool"), F.lit(s).alias("severity"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())
    hits = F.transform(F.array(F.lower("text")), hits_of)[0]
    x = body.select("pr_id", "path", F.coalesce("new_line", F.lit(0)).alias("line"),
                    F.explode(hits).alias("h"))
    return x.select("pr_id", F.col("h.tool").alias("tool"), F.col("h.rule_id").alias("rule_id"),
                    F.col("h.severity").alias("severity"), "path", F.col("line").cast("bigint").alias("line"))


def hunk_prefilter(patterns) -> str:
    """One pattern that matches a whole hunk whenever any line rule could match one of
    its lines: the rules OR-ed, each in its own group (scoped flags), with line anchors
    (``^``, ``$`` outside classes) dropped so the screen can only over-approximate."""
    def loose(p: str) -> str:
        flags = "(?i)" if p.startswith("(?i)") else ""
        return flags + _drop_anchors(p[len(flags):])
    return "|".join(f"(?:{loose(p)})" for p in patterns)


def _drop_anchors(p: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(p):
        c = p[i]
        if c == "\\":
            out.append(p[i:i + 2])
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        if c in "^$" and not in_class:  # line anchors do not hold inside a hunk
            i += 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


#: what a pattern may look at beside its match: on a whole hunk it could refuse a line's hit
_LOOKS_AROUND = ("(?!", "(?=", "(?<", "\\b", "\\B", "\\A", "\\z", "\\Z", "\\G")


def screen_hunks(hunks: DataFrame, patterns, words: dict[str, list[str]] | None = None) -> DataFrame:
    """Hunks that may hold a rule hit (map-side ``rlike``); only these are exploded. Rules that
    look around their match can't be screened: with one of them every hunk stays. ``words`` has, by
    pattern, words of which every text with a hit holds one (in lower case for a pattern that ignores
    case): a hunk without them is not held against the pattern."""
    if any(mark in p for p in patterns for mark in _LOOKS_AROUND):
        return hunks
    words = words or {}

    def may_hold(p: str, lower: Column) -> Column:
        hit = F.col("hunk").rlike(hunk_prefilter([p]))
        return _holds(lower if p.startswith("(?i)") else F.col("hunk"), words[p]) & hit
    found = []
    if known := [p for p in patterns if p in words]:
        found.append(F.transform(F.array(F.lower("hunk")), lambda t: reduce(lambda a, b: a | b, [may_hold(p, t) for p in known]))[0])
    if other := [p for p in patterns if p not in words]:
        found.append(F.col("hunk").rlike(hunk_prefilter(other)))
    return hunks.filter(reduce(lambda a, b: a | b, found)) if found else hunks


def filter_severity(df: DataFrame, levels=("HIGH", "CRITICAL"), col: str = "severity") -> DataFrame:
    """Keep the listed severities."""
    return df.filter(F.upper(F.col(col)).isin(*[lv.upper() for lv in levels]))


def scan_summary(findings: DataFrame, prs: DataFrame) -> DataFrame:
    """Per PR, ``=== <Tool> findings ===`` sections joined by a blank line; '' when
    a PR has no findings. One partial-aggregated shuffle on ``(pr_id, tool)``."""
    line = F.concat_ws(" ", "severity", "rule_id", F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string")))
    per_tool = findings.withColumn("l", line).groupBy("pr_id", "tool").agg(
        F.expr("listagg(l, '\\n') WITHIN GROUP (ORDER BY path, line, rule_id, severity)").alias("body"))
    order = F.array_position(F.array(*[F.lit(t) for t in TOOL_ORDER]), F.col("tool"))
    sec = per_tool.select("pr_id", order.alias("o"),
                          F.concat(F.lit("=== "), F.col("tool"), F.lit(" findings ===\n"), F.col("body")).alias("s"))
    per_pr = sec.groupBy("pr_id").agg(
        F.expr("listagg(s, '\\n\\n') WITHIN GROUP (ORDER BY o)").alias("scan_summary"),
        F.count("*").cast("bigint").alias("n_tools"))
    return prs.select("pr_id").join(per_pr, "pr_id", "left").select(
        "pr_id", F.coalesce("scan_summary", F.lit("")).alias("scan_summary"),
        F.coalesce("n_tools", F.lit(0)).cast("bigint").alias("n_tools"))
