"""Registered queries over rule reviewers (H) on the F0 diff line table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diffs as D
from ..operators import privacy as PV
from ..operators import rules as H
from ..sources import fixtures as fx
from . import oracle_fixtures as O
from .catalog import register
from .q_diffs import _LINES_SQL


_TEST = O.q(D.TEST_PATH)


def _rule_values() -> str:
    rows = []
    for r, a, c, d, p in H.LINE_RULES:
        rows.append(f"({O.q(r)}, {O.q(a)}, {c}, {O.q(d)}, {O.q(p)}, {str(r in H.TEST_ONLY_RULES).lower()})")
    return ", ".join(rows)


@register("rule_findings", f"""WITH {O.F0}, {_LINES_SQL},
rules AS (SELECT * FROM (VALUES {_rule_values()}) AS t(rule_id, agent, confidence_score, description, pattern, test_only))
SELECT pr_id, agent, rule_id, description, path AS file_reference, CAST(coalesce(new_line, 0) AS BIGINT) AS line_number,
  CAST(confidence_score AS DOUBLE) AS confidence_score
FROM lines, rules WHERE sign = '+' AND regexp_matches(text, pattern) AND (NOT test_only OR regexp_matches(path, {_TEST}))
UNION ALL
SELECT pr_id, 'testing', 'unmocked-network-in-test', 'Network call in a test without a mock', path,
  CAST(coalesce(min(CASE WHEN sign = '+' AND regexp_matches(text, {O.q(H.NETWORK)}) THEN new_line END), 0) AS BIGINT), 0.7
FROM lines WHERE regexp_matches(path, {_TEST}) AND sign IN ('+', ' ') GROUP BY pr_id, path
HAVING bool_or(sign = '+' AND regexp_matches(text, {O.q(H.NETWORK)})) AND NOT bool_or(regexp_matches(text, {O.q(H.MOCKING)}))""")
def rule_findings(spark, sf_dir):
    """H1 + H2 + H6: sleep in tests, unmocked network calls in tests, injection-prone
    calls; findings in the common Finding schema."""
    # Only hunks that can hold a hit are exploded; a file's hunk carries all its lines,
    # so the mock check of H2 still sees the whole file.
    hunks = D.split_hunks(fx.prs(spark, sf_dir))
    lines = D.diff_lines(PV.screen_hunks(hunks, [p for *_, p in H.LINE_RULES] + [H.NETWORK], H.LINE_WORDS))
    return H.rule_findings(lines).unionByName(H.unmocked_network(lines))


@register("coverage_gap", f"""WITH {O.F0}, {_LINES_SQL},
cf AS (SELECT DISTINCT pr_id, path, regexp_matches(path, {_TEST}) AS is_test FROM lines WHERE path <> ''),
g AS (SELECT pr_id, CAST(count(*) FILTER (WHERE NOT is_test AND regexp_matches(path, {O.q(H.SOURCE_EXT)})) AS BIGINT) AS n_source_files,
  CAST(count(*) FILTER (WHERE is_test) AS BIGINT) AS n_test_files FROM cf GROUP BY pr_id)
SELECT *, NOT (n_source_files > 0 AND n_test_files = 0) AS coverage_adequate FROM g""")
def coverage_gap(spark, sf_dir):
    """H3: PRs that change source files without touching any test file."""
    return H.coverage_gap(D.hunk_files(D.split_hunks(fx.prs(spark, sf_dir))))


@register("duplicate_blocks", f"""WITH {O.F0}, {_LINES_SQL},
a AS (SELECT *, regexp_replace(trim(text), '\\s+', ' ', 'g') AS norm FROM lines WHERE sign = '+'),
a2 AS (SELECT * FROM a WHERE length(norm) >= 1),
b AS (SELECT *, list(norm) OVER (PARTITION BY pr_id, hunk_no ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS block FROM a2),
k AS (SELECT md5(array_to_string(block, chr(10))) AS block_md5, pr_id, path, new_line FROM b WHERE len(block) = 5)
SELECT block_md5, n_occurrences, fst.pr_id AS first_pr_id, fst.path AS first_path, fst.new_line AS first_line
FROM (SELECT block_md5, CAST(count(*) AS BIGINT) AS n_occurrences,
  min({{'pr_id': pr_id, 'path': path, 'new_line': new_line}}) AS fst FROM k GROUP BY block_md5 HAVING count(*) >= 2)""")
def duplicate_blocks(spark, sf_dir):
    """H4: 5-line blocks of added code repeated anywhere across all PRs."""
    return H.duplicate_blocks(D.split_hunks(fx.prs(spark, sf_dir)), k=5)


def _dep_sql() -> str:
    arms = " ".join(f"WHEN regexp_matches(text, {O.q(p)}) THEN regexp_extract(text, {O.q(p)}, 1)" for p in H.DEP_PATTERNS)
    return f"CASE {arms} END"


@register("added_dependencies", f"""WITH {O.F0}, {_LINES_SQL},
d AS (SELECT pr_id, path AS file_reference, CAST(new_line AS BIGINT) AS line_number, {_dep_sql()} AS dependency
  FROM lines WHERE sign = '+' AND regexp_matches(path, {O.q(H.MANIFESTS)}))
SELECT * FROM d WHERE dependency IS NOT NULL AND dependency <> ''""")
def added_dependencies(spark, sf_dir):
    """H5: dependencies added in manifest files."""
    hunks = D.split_hunks(fx.prs(spark, sf_dir)).filter(F.col("path").rlike(H.MANIFESTS))
    return H.added_dependencies(D.diff_lines(hunks))
