"""Registered queries over diff operators (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import diffs as D
from ..sources import fixtures as fx
from . import oracle_fixtures as O
from .catalog import register

_HUNKS_SQL = f"""h0 AS (SELECT pr_id, {O.hunks_of('diff')} AS l FROM prs),
h AS (SELECT pr_id, CAST(i AS INTEGER) AS hunk_no, l[i + 1] AS hunk FROM h0, unnest(range(len(l))) AS t(i)
  WHERE l[i + 1] <> ''),
hk AS (SELECT *, {O.first_line('hunk')} AS first_line, {O.hunk_path('hunk')} AS path,
  {O.is_bloat('hunk')} AS is_bloat FROM h)"""


@register("hunks_kept", f"""WITH {O.F0}, {_HUNKS_SQL}
SELECT pr_id, hunk_no, path, is_bloat, CAST(length(hunk) AS BIGINT) AS hunk_len FROM hk""")
def hunks_kept(spark, sf_dir):
    """B1 + B2: every hunk with its path and bloat flag (kept = not bloat)."""
    h = D.split_hunks(fx.prs(spark, sf_dir))
    return h.select("pr_id", "hunk_no", "path", "is_bloat", F.length("hunk").cast("bigint").alias("hunk_len"))


@register("bloat_literal_mode", f"""WITH {O.F0}, {_HUNKS_SQL}
SELECT pr_id, hunk_no, regexp_matches(first_line, {O.q('(?i)' + '|'.join('(?:' + p + ')' for p in P.BLOAT_HEADER_PATTERNS))})
  AS is_bloat_literal FROM hk""")
def bloat_literal_mode(spark, sf_dir):
    """B2 with the service's header patterns as written (a space must precede the name)."""
    h = D.split_hunks(fx.prs(spark, sf_dir), mode="literal")
    return h.select("pr_id", "hunk_no", F.col("is_bloat").alias("is_bloat_literal"))


@register("guardrail_stats", f"""WITH {O.F0},
s AS (SELECT pr_id, list_filter({O.hunks_of('diff')}, lambda h: h <> '') AS l, {O.filtered('diff')} AS f FROM prs)
SELECT pr_id, CAST(len(l) AS BIGINT) AS n_hunks, CAST(len(list_filter(l, lambda h: {O.is_bloat('h')})) AS BIGINT) AS n_dropped,
  CAST(length(f) AS BIGINT) AS filtered_len, length(f) > {P.MAX_DIFF_LENGTH} AS truncated FROM s""")
def guardrail_stats(spark, sf_dir):
    """Hunks dropped per PR and whether the cap fires (map-side, no shuffle)."""
    return D.guardrail_stats(fx.prs(spark, sf_dir))


@register("capped_diffs", f"""WITH {O.F0},
c AS (SELECT pr_id, {O.capped(O.filtered('diff'))} AS capped FROM prs)
SELECT pr_id, CAST(length(capped) AS BIGINT) AS capped_len, md5(capped) AS capped_md5 FROM c""")
def capped_diffs(spark, sf_dir):
    """The capped diff, the one query whose feature the cap is (row form, map-side)."""
    c = D.guard_diff(fx.prs(spark, sf_dir), max_len=P.MAX_DIFF_LENGTH)
    return c.select("pr_id", F.length("capped_diff").cast("bigint").alias("capped_len"),
                    F.md5("capped_diff").alias("capped_md5"))


_LINES_SQL = f"""{_HUNKS_SQL},
l0 AS (SELECT pr_id, hunk_no, path, string_split(hunk, chr(10)) AS ls FROM hk),
l1 AS (SELECT pr_id, hunk_no, path, CAST(i AS INTEGER) AS pos, ls[i + 1] AS line, i = len(ls) - 1 AS is_last FROM l0, unnest(range(len(ls))) AS t(i)),
l2 AS (SELECT *, starts_with(line, '@@') AS is_hdr,
  CASE WHEN regexp_matches(line, '^@@ -[0-9]+(?:,[0-9]+)? \\+([0-9]+)')
    THEN TRY_CAST(regexp_extract(line, '^@@ -[0-9]+(?:,[0-9]+)? \\+([0-9]+)', 1) AS BIGINT) END AS sec_start FROM l1),
l3 AS (SELECT *, sum(CAST(is_hdr AS INTEGER)) OVER w AS sec FROM l2
  WINDOW w AS (PARTITION BY pr_id, hunk_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l4 AS (SELECT *, CASE WHEN NOT (sec > 0 AND NOT is_hdr) THEN 'h' WHEN substr(line, 1, 1) = '+' THEN '+'
  WHEN substr(line, 1, 1) = '-' THEN '-' WHEN substr(line, 1, 1) = '\\' THEN '\\' WHEN substr(line, 1, 1) = ' ' THEN ' '
  WHEN line = chr(13) OR (line = '' AND NOT is_last) THEN ' ' ELSE '?' END AS sign,
  max(sec_start) OVER (PARTITION BY pr_id, hunk_no, sec) AS base FROM l3),
l5 AS (SELECT *, sum(CASE WHEN sign IN ('+', ' ') THEN 1 ELSE 0 END) OVER (PARTITION BY pr_id, hunk_no, sec ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_new FROM l4),
lines AS (SELECT pr_id, hunk_no, pos, path, sign,
  CAST(CASE WHEN sign IN ('+', ' ') THEN base + n_new - 1 END AS BIGINT) AS new_line,
  CASE WHEN sign IN ('+', '-', ' ') THEN substr(line, 2) ELSE line END AS text FROM l5)"""


@register("diff_lines", f"""WITH {O.F0}, {_LINES_SQL}
SELECT pr_id, hunk_no, pos, path, sign, new_line, CAST(length(text) AS BIGINT) AS text_len FROM lines""")
def diff_lines_q(spark, sf_dir):
    """One row per diff line with path, sign and counted new-file line number."""
    lines = D.diff_lines(D.split_hunks(fx.prs(spark, sf_dir)))
    return lines.select("pr_id", "hunk_no", "pos", "path", "sign", "new_line",
                        F.length("text").cast("bigint").alias("text_len"))


@register("diff_lines_stats", f"""WITH {O.F0}, {_LINES_SQL}
SELECT pr_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE sign = '+') AS BIGINT) AS n_added,
  CAST(count(*) FILTER (WHERE sign = '-') AS BIGINT) AS n_removed, max(new_line) AS max_new_line,
  CAST(count(DISTINCT path) AS BIGINT) AS n_files FROM lines GROUP BY pr_id""")
def diff_lines_stats(spark, sf_dir):
    """B6 rolled up per PR (partial aggregation before the shuffle on pr_id)."""
    lines = D.diff_lines(D.split_hunks(fx.prs(spark, sf_dir)))
    return lines.groupBy("pr_id").agg(
        F.count("*").cast("bigint").alias("n_lines"),
        F.count_if(F.col("sign") == "+").cast("bigint").alias("n_added"),
        F.count_if(F.col("sign") == "-").cast("bigint").alias("n_removed"),
        F.max("new_line").alias("max_new_line"),
        F.countDistinct("path").cast("bigint").alias("n_files"))


@register("changed_files", f"""WITH {O.F0}, {_LINES_SQL}
SELECT pr_id, path, CAST(count(*) FILTER (WHERE sign = '+') AS BIGINT) AS added,
  CAST(count(*) FILTER (WHERE sign = '-') AS BIGINT) AS removed, regexp_matches(path, {O.q(D.TEST_PATH)}) AS is_test
FROM lines WHERE path <> '' GROUP BY pr_id, path""")
def changed_files(spark, sf_dir):
    """Distinct changed files per PR with test flag and line counts."""
    return D.changed_files(D.diff_lines(D.split_hunks(fx.prs(spark, sf_dir))))
