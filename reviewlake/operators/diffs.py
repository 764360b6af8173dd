"""Diff operators (split, bloat filter, cap, line table, changed files, large-PR rule).

The model-facing path (split -> drop bloat -> rejoin -> cap) is a per-row projection:
array ``split`` / ``filter`` / ``array_join`` on the PR row, so it needs no shuffle and
runs in streams without state. The exploded tables (hunks, diff lines) are for the
scanners and the critic joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import count_splitlines, first_line, lit_str

# Split before every line that starts with "diff --git "; (?d) keeps ^ to "\n" only.
HUNK_SPLIT = "(?md)^(?=diff --git )"
_LITERAL_BLOAT = "(?id)" + "|".join("(?:" + p + ")" for p in P.BLOAT_HEADER_PATTERNS)


def path_sql(hunk: str) -> str:
    """SQL for the new-side path of a file's hunk; '' when it doesn't begin with a header.

    ``+++ b/path`` above the first ``@@`` says it; for files without one (deleted, binary,
    renamed) ``rename to``, else the header, whose two halves are equal but for their
    prefixes, else its last word. A carriage return, a tab and what follows, and the quotes
    of a quoted name are not part of it (octal escapes in such a name stay as written).
    """
    first = f"regexp_replace(substring_index({hunk}, '\\n', 1), '\\r$', '')"
    top = f"substring_index({hunk}, '\\n@@', 1)"
    line = lambda lead: f"regexp_extract({top}, '(?m)^{lead} ([^\\t\\r\\n]+)', 1)"
    bare = lambda x: f"regexp_replace({x}, '^\"(.*)\"$', '$1')"
    plus, renamed = bare(line("[+][+][+]")), bare(line("rename to"))
    rest = f"substring({first}, 12)"
    half = f"((length({rest}) - 1) div 2)"
    left, right = bare(f"substring({rest}, 1, {half})"), bare(f"substring({rest}, {half} + 2)")
    no_a, no_b = (f"regexp_replace({x}, '^{c}/', '')" for c, x in (("a", left), ("b", right)))
    ab = f"({first} rlike '^diff --git \"?a/.* \"?b/')"
    last = f"regexp_replace({bare(f"regexp_extract({rest}, '([^ ]+)$', 1)")}, '^b/', '')"
    return (f"(CASE WHEN NOT startswith({hunk}, 'diff --git ') THEN '' "
            f"WHEN {plus} NOT IN ('', '/dev/null') THEN CASE WHEN {ab} THEN regexp_replace({plus}, '^b/', '') ELSE {plus} END "
            f"WHEN {renamed} <> '' THEN {renamed} "
            f"WHEN {ab} AND {no_a} = {no_b} THEN {no_b} WHEN {left} = {right} THEN {right} "
            f"WHEN {ab} THEN {last} ELSE {bare(f"regexp_extract({rest}, '([^ ]+)$', 1)")} END)")


def hunk_path(hunk: str = "hunk") -> Column:
    return F.expr(path_sql(hunk))


def _bloat_sql(x: str, mode: str) -> str:
    """SQL: does the hunk touch a generated / vendored / lock file?

    ``mode='literal'`` applies the service's header patterns as written (they need a
    space right before the name); ``mode='path'`` applies the same rules to the path.
    """
    if mode == "literal":
        return f"(substring_index({x}, '\\n', 1) rlike {lit_str(_LITERAL_BLOAT)})"
    if mode == "path":
        return f"({path_sql(x)} rlike {lit_str(P.BLOAT_PATH_PATTERN)})"
    raise ValueError(f"unknown bloat mode {mode!r}")


def filtered_diff(col_sql: str = "diff", mode: str = "path") -> Column:
    """Split into hunks, drop bloat hunks and rejoin, all inside the row."""
    return F.expr(f"array_join(filter(split({col_sql}, {lit_str(HUNK_SPLIT)}, -1), "
                  f"h -> NOT {_bloat_sql('h', mode)}), '')")


def cap_text(c: Column, max_len: int | None) -> Column:
    """First ``max_len`` characters plus the truncation marker when longer; None: all."""
    if max_len is None:
        return c
    return F.when(F.length(c) > max_len,
                  F.concat(F.substring(c, 1, max_len), F.lit(P.TRUNCATION_MARKER))).otherwise(c)


def guard_diff(df: DataFrame, diff_col: str = "diff", out: str = "capped_diff",
               mode: str = "path", max_len: int | None = None) -> DataFrame:
    """Token guardrail on each PR row: drop bloat hunks (B1+B2) and, if ``max_len`` is
    given, cap the text (B3). Map-side."""
    return df.withColumn(out, cap_text(filtered_diff(diff_col, mode), max_len))


def guardrail_stats(df: DataFrame, diff_col: str = "diff", mode: str = "path",
                    max_len: int = P.MAX_DIFF_LENGTH) -> DataFrame:
    """Per PR: hunks, dropped hunks, filtered length, truncated flag (B4, map-side)."""
    pieces = F.split(F.col(diff_col), HUNK_SPLIT, -1)
    dropped = F.expr(f"size(filter(split({diff_col}, {lit_str(HUNK_SPLIT)}, -1), "
                     f"h -> {_bloat_sql('h', mode)}))")
    flen = F.length(filtered_diff(diff_col, mode))
    return df.select(
        "pr_id",
        F.size(F.filter(pieces, lambda h: h != "")).cast("bigint").alias("n_hunks"),
        dropped.cast("bigint").alias("n_dropped"),
        flen.cast("bigint").alias("filtered_len"),
        (flen > max_len).alias("truncated"))


def split_hunks(df: DataFrame, diff_col: str = "diff", mode: str = "path") -> DataFrame:
    """One row per hunk (B1): ``pr_id, hunk_no, first_line, path, is_bloat, hunk``.

    Java's split drops the empty piece before a leading header, Python keeps it; empty
    pieces carry nothing, so they are left out and numbering starts at the first piece.
    """
    h = df.select("pr_id", F.posexplode(F.split(F.col(diff_col), HUNK_SPLIT, -1)).alias("hunk_no", "hunk"))
    h = h.filter(F.col("hunk") != "")
    fl = first_line(F.col("hunk"))
    return h.select("pr_id", F.col("hunk_no").cast("int"), fl.alias("first_line"),
                    hunk_path().alias("path"), F.expr(_bloat_sql("hunk", mode)).alias("is_bloat"), "hunk")


def drop_bloat(hunks: DataFrame) -> DataFrame:
    """Keep hunks that are not bloat (B2)."""
    return hunks.filter(~F.col("is_bloat"))


def cap_diff(hunks: DataFrame, prs: DataFrame, max_len: int = P.MAX_DIFF_LENGTH) -> DataFrame:
    """Regroup kept hunks into one capped diff per PR (B3, table form).

    Only the first ``max_len`` characters are ever concatenated: a running length over
    the PR's hunks keeps hunks that start inside the cap and trims the last one, so the
    aggregated string is bounded whatever the PR size. PRs whose hunks all dropped come
    back as ''.
    """
    w = Window.partitionBy("pr_id").orderBy("hunk_no")
    h = hunks.select("pr_id", "hunk_no", "hunk", F.length("hunk").alias("len"))
    h = h.withColumn("end", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("total", F.sum("len").over(Window.partitionBy("pr_id")))
    h = h.withColumn("start", F.col("end") - F.col("len"))
    kept = h.filter(F.col("start") < max_len).withColumn(
        "piece", F.substring("hunk", 1, F.least(F.col("len"), F.lit(max_len) - F.col("start")).cast("int")))
    agg = kept.groupBy("pr_id").agg(
        F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY hunk_no)").alias("joined"),
        F.max("total").alias("total"))
    capped = F.when(F.col("total") > max_len, F.concat("joined", F.lit(P.TRUNCATION_MARKER))).otherwise(F.col("joined"))
    out = agg.select("pr_id", capped.alias("capped_diff"))
    return prs.select("pr_id").join(out, "pr_id", "left").select(
        "pr_id", F.coalesce("capped_diff", F.lit("")).alias("capped_diff"))


def line_count(c: Column) -> Column:
    """``len(text.splitlines())``."""
    return count_splitlines(c)


SECTION_SPLIT = "(?md)^(?=@@)"
SECTION_START = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)"


def _sections(hunks: DataFrame) -> DataFrame:
    """Each hunk with ``secs``: its sections in order (the part above the first ``@@`` is one),
    with the number of lines before it, the new-side number it starts at (NULL where that is no
    64-bit number) and its signed lines. Row-local."""
    x = hunks.withColumn("secs", F.split("hunk", SECTION_SPLIT, -1))
    x = x.withColumn("__n", F.expr("transform(secs, s -> length(s) - length(replace(s, '\\n', '')))"))
    # every section but the last ends with a line feed, which belongs to its last line
    x = x.withColumn("secs", F.expr(
        "transform(secs, (s, i) -> named_struct('before', aggregate(slice(__n, 1, i), 0, (a, k) -> a + k), "
        "'last', i = size(secs) - 1, 'counts', startswith(s, '@@'), "
        f"'base', try_cast(regexp_extract(s, {lit_str(SECTION_START)}, 1) AS bigint), "
        "'ls', split(IF(i = size(secs) - 1, s, substring(s, 1, length(s) - 1)), '\\n', -1)))")).drop("__n")
    return x.withColumn("secs", F.expr(
        "transform(secs, s -> named_struct('before', s.before, 'counts', s.counts, 'base', s.base, 'ls', "
        "transform(s.ls, (l, k) -> named_struct('k', k, 'line', l, 'sign', CASE WHEN NOT s.counts OR k = 0 THEN 'h' "
        "WHEN left(l, 1) IN ('+', '-', ' ', '\\\\') THEN left(l, 1) "
        "WHEN l = '\\r' OR (l = '' AND NOT (s.last AND k = size(s.ls) - 1)) THEN ' ' ELSE '?' END))))"))


_NEW_SIDE = "sign IN ('+', ' ')"


def _numbered(hunks: DataFrame) -> DataFrame:
    """Hunks with ``ls``: all lines as structs (pos, sign, new_line, text). The k-th new-side line
    of a section has number base + k."""
    text = "CASE WHEN y.sign IN ('+', '-', ' ') THEN substring(y.line, 2) ELSE y.line END"
    pos = "'pos', s.before + y.k, 'sign', y.sign"
    return _sections(hunks).withColumn("ls", F.expr(
        f"flatten(transform(secs, s -> concat(transform(filter(s.ls, y -> y.{_NEW_SIDE}), (y, k) -> named_struct({pos}, "
        f"'new_line', try_add(s.base, cast(k AS bigint)), 'text', {text})), transform(filter(s.ls, y -> NOT y.{_NEW_SIDE}), "
        f"y -> named_struct({pos}, 'new_line', cast(NULL AS bigint), 'text', {text})))))")).drop("secs")


def diff_lines(hunks: DataFrame) -> DataFrame:
    """One row per diff line (B6): ``pr_id, hunk_no, pos, path, sign, new_line, text``.

    ``new_line`` is counted, not read from the ``@@`` header's length: each ``@@ … +N``
    starts a section at N, and context/added lines take the next number (an empty line is a
    context line whose blank was stripped). Removed lines and ``\\ No newline`` markers get
    none, nor do lines of a section whose N is no 64-bit number. All of it is computed inside
    the hunk's row: no window, no shuffle.
    """
    return _numbered(hunks.select("pr_id", "hunk_no", "path", "hunk")).select(
        "pr_id", "hunk_no", "path", F.inline("ls")).select("pr_id", "hunk_no", "pos", "path", "sign", "new_line", "text")


def line_ranges(hunks: DataFrame) -> DataFrame:
    """Changed files (B7) with their new-side line numbers: ``pr_id, path, is_test, ranges``.
    A section's context and added lines are numbered without gaps, so one range (lo, hi) per
    section holds them all; the ranges are made in the row and only they are grouped by file."""
    x = _sections(hunks.filter(F.col("path") != "").select("pr_id", "path", "hunk"))
    x = x.select("pr_id", "path", F.expr(
        f"filter(transform(filter(secs, s -> s.base IS NOT NULL), s -> named_struct('lo', s.base, 'hi', "
        f"try_add(s.base, cast(size(filter(s.ls, y -> y.{_NEW_SIDE})) AS bigint) - 1))), r -> r.hi >= r.lo)").alias("ranges"))
    return (x.groupBy("pr_id", "path").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
            .withColumn("is_test", F.col("path").rlike(TEST_PATH)))


TEST_PATH = r"(?i)(^|/)(tests?|spec|__tests__)/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.spec\.[a-z]+$|\.test\.[a-z]+$"


def hunk_files(hunks: DataFrame) -> DataFrame:
    """Distinct (pr, path) with test flag straight from hunk headers (no line explode)."""
    return hunks.filter(F.col("path") != "").select("pr_id", "path").distinct() \
        .withColumn("is_test", F.col("path").rlike(TEST_PATH))


def changed_files(lines: DataFrame) -> DataFrame:
    """Distinct (pr, path) with test flag and added / removed counts."""
    body = lines.filter(F.col("path") != "")
    return body.groupBy("pr_id", "path").agg(
        F.count_if(F.col("sign") == "+").cast("bigint").alias("added"),
        F.count_if(F.col("sign") == "-").cast("bigint").alias("removed")
    ).withColumn("is_test", F.col("path").rlike(TEST_PATH))


def apply_large_pr_rule(arch: DataFrame, prs: DataFrame, diff_col: str = "sanitized_diff",
                        threshold: int = P.LARGE_PR_THRESHOLD, applies=None) -> DataFrame:
    """PRs over ``threshold`` lines turn ``pass`` into ``warn`` and get the fixed
    High Risk finding appended once. ``arch`` has ``pr_id, status, findings`` (array of
    finding structs); ``prs`` has the masked, capped diff, or ``n_lines`` in its place; ``applies`` optionally limits
    the rule to some rows (e.g. architecture results that did not time out). Adds
    ``n_lines`` and ``is_large``."""
    from .contracts import FINDINGS_TYPE
    note = F.struct(F.lit(P.LARGE_PR_NOTE).alias("description"), F.lit("N/A").alias("file_reference"),
                    F.lit(0).alias("line_number"), F.lit(1.0).alias("confidence_score")).cast(FINDINGS_TYPE[6:-1])
    lines = line_count(F.col(diff_col)) if diff_col in prs.columns else F.col("n_lines")
    j = arch.join(prs.select("pr_id", lines.alias("n_lines")), "pr_id", "left")
    large = F.coalesce(F.col("n_lines"), F.lit(0)) > threshold
    if applies is not None:
        large = large & applies
    findings = F.coalesce(F.col("findings"), F.array().cast(FINDINGS_TYPE))
    return (j.withColumn("status", F.when(large & (F.col("status") == "pass"), F.lit("warn")).otherwise(F.col("status")))
            .withColumn("findings", F.when(large & ~F.array_contains(findings, note), F.array_append(findings, note))
                        .otherwise(F.col("findings")))
            .withColumn("is_large", large))
