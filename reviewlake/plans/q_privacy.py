"""Registered queries over masking and secret operators (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import diffs as D
from ..operators import privacy as PV
from ..sources import fixtures as fx
from . import oracle_fixtures as O
from .catalog import register
from .context import ReviewContext

EMAIL = dict(P.ENTITY_PATTERNS)["EMAIL_ADDRESS"]
IP = dict(P.ENTITY_PATTERNS)["IP_ADDRESS"]
SECRET = "(?s)" + P.SECRET_ASSIGN_PATTERN            # DuckDB / RE2 (its (?U) means "ungreedy")
SECRET_SPARK = "(?sU)" + P.SECRET_ASSIGN_PATTERN     # Java: Unicode \s like the Python service


def _mask_counts_oracle() -> str:
    c = O.filtered("diff")
    return f"""WITH {O.F0},
c AS (SELECT pr_id, {c} AS kept FROM prs),
m1 AS (SELECT *, {O.n_matches('kept', EMAIL)} AS n_email,
  {O.replace_all('kept', EMAIL, '<EMAIL_ADDRESS>')} AS t1 FROM c),
m2 AS (SELECT *, {O.count_entity('t1', 'IP_ADDRESS', IP)} AS n_ip, {O.mask_entity('t1', 'IP_ADDRESS', IP)} AS t2 FROM m1),
m3 AS (SELECT *, {O.n_matches('t2', SECRET)} AS n_secret,
  {O.replace_all('t2', SECRET, P.SECRET_LABEL)} AS t3 FROM m2)
SELECT pr_id, CAST(length(kept) AS BIGINT) AS diff_len, n_email, n_ip, n_secret,
  CAST(length(t3) AS BIGINT) AS sanitized_len, md5(t3) AS sanitized_md5 FROM m3"""


@register("sanitized_mask_counts", _mask_counts_oracle())
def sanitized_mask_counts(spark, sf_dir):
    """Flagship: F0 -> split, drop bloat, rejoin -> e-mail, IP, secret masking ->
    per-PR mask counts and a digest of the sanitized diff. All map-side after F0."""
    g = D.guard_diff(fx.prs(spark, sf_dir))
    x = g.select("pr_id", F.col("capped_diff").alias("kept"))
    counts = PV.entity_counts(x, "kept", "pr_id", ["EMAIL_ADDRESS", "IP_ADDRESS"], masked="t2", keep=["kept"])
    x = counts.select("pr_id", "kept", F.col("n_email_address").alias("n_email"), F.col("n_ip_address").alias("n_ip"), "t2")
    x = PV.counted_replace(x, "t2", SECRET_SPARK, P.SECRET_LABEL, "n_secret", "t3")
    return x.select("pr_id", F.length("kept").cast("bigint").alias("diff_len"), "n_email", "n_ip",
                    "n_secret", F.length("t3").cast("bigint").alias("sanitized_len"),
                    F.md5("t3").alias("sanitized_md5"))


def _read(spark, sf_dir, name):
    from ..session import spread
    from ..sources.tables import read_table
    return spread(read_table(spark, sf_dir, name))


@register("doc_mask_email_ip", f"""WITH m AS (SELECT doc_id,
  {O.mask_entity(O.replace_all('text', EMAIL, '<EMAIL_ADDRESS>'), 'IP_ADDRESS', IP)} AS masked FROM documents)
SELECT doc_id, CAST(length(masked) AS BIGINT) AS masked_len, md5(masked) AS masked_md5 FROM m""")
def doc_mask_email_ip(spark, sf_dir):
    """C1 + C3 straight on ``documents.text`` (map-side)."""
    d = PV.mask_entities(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text",
                         ["EMAIL_ADDRESS", "IP_ADDRESS"], out="masked")
    return d.select("doc_id", F.length("masked").cast("bigint").alias("masked_len"), F.md5("masked").alias("masked_md5"))


@register("page_mask_secrets", f"""WITH m AS (SELECT page_id, {O.mask_secrets('html')} AS masked FROM pages)
SELECT page_id, CAST(length(masked) AS BIGINT) AS masked_len, md5(masked) AS masked_md5 FROM m""")
def page_mask_secrets(spark, sf_dir):
    """C10-C12 on raw web pages (PEM guarded by a cheap contains)."""
    p = PV.mask_secrets(_read(spark, sf_dir, "pages").select("page_id", "html"), "html", out="masked")
    return p.select("page_id", F.length("masked").cast("bigint").alias("masked_len"), F.md5("masked").alias("masked_md5"))


_COUNT_COLS = ", ".join(f"n_{n.lower()}" for n, _ in P.ENTITY_PATTERNS)


@register("doc_entity_counts", f"""WITH src AS (SELECT doc_id, text FROM documents),
{O.mask_chain_ctes('src', 'doc_id', 'text', 'm')}
SELECT doc_id, {_COUNT_COLS} FROM m""")
def doc_entity_counts(spark, sf_dir):
    """C1-C7 counts per document, each entity counted after higher-priority masks."""
    return PV.entity_counts(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@register("conversation_masks", f"""WITH src AS (SELECT conv_id, turn, text FROM conversations),
{O.mask_chain_ctes('src', 'conv_id, turn', 'text', 'm')},
s AS (SELECT conv_id, turn, {O.mask_secrets('t7')} AS masked FROM m)
SELECT conv_id, turn, CAST(length(masked) AS BIGINT) AS masked_len, md5(masked) AS masked_md5 FROM s""")
def conversation_masks(spark, sf_dir):
    """Full entity (C1-C7) and secret (C10-C12) masking on conversation turns."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    c = PV.mask_secrets(PV.mask_entities(c, "text", out="masked"), "masked")
    return c.select("conv_id", "turn", F.length("masked").cast("bigint").alias("masked_len"),
                    F.md5("masked").alias("masked_md5"))


def _spans_oracle() -> str:
    ctes = []
    for name, pat in P.ENTITY_PATTERNS:
        chk = P.VALIDATED_ENTITIES.get(name)
        part = O.part("x", chk) if chk else "x"
        pp, hh = f"string_split_regex(text, {O.q(pat)})", f"regexp_extract_all(text, {O.q(pat)})"
        ctes.append(
            f"SELECT doc_id, '{name}' AS entity, {P.ENTITY_PRIORITY[name]} AS prio, unnest(list_transform({hh}, "
            f"lambda x, i: {{'s': coalesce(list_sum(list_transform(list_slice({pp}, 1, i), lambda q: length(q))), 0) + "
            f"coalesce(list_sum(list_transform(list_slice({hh}, 1, i - 1), lambda q: length(q))), 0), "
            f"'len': length({part})}})) AS sp FROM documents")
    allsp = " UNION ALL ".join(ctes)
    return f"""WITH a0 AS ({allsp}),
a AS (SELECT doc_id, entity, prio, sp.s AS s, sp.len AS len FROM a0 WHERE sp.len IS NOT NULL)
SELECT doc_id, entity, CAST(s AS BIGINT) AS start, CAST(s + len AS BIGINT) AS "end" FROM a
WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.doc_id = a.doc_id AND b.s < a.s + a.len AND a.s < b.s + b.len
  AND (b.prio < a.prio OR (b.prio = a.prio AND (b.len > a.len OR (b.len = a.len AND b.s < a.s)))))"""


@register("doc_entity_spans", _spans_oracle())
def doc_entity_spans(spark, sf_dir):
    """Winning entity spans per document (overlaps resolved inside each row)."""
    return PV.entity_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


#: the names as one alternation, longer ones first
_NAMES = O.q("\\b(" + "|".join(n.replace(" ", "[ \\t]+") for n in sorted(P.DEFAULT_PERSON_NAMES, key=len, reverse=True)) + ")\\b")


def _persons_oracle() -> str:
    return f"""WITH m AS (SELECT doc_id, regexp_replace(text, {_NAMES}, '<PERSON>', 'g') AS masked
  FROM documents)
SELECT doc_id, CAST(length(masked) AS BIGINT) AS masked_len, md5(masked) AS masked_md5 FROM m"""


# RE2's word boundary is ASCII-only where the operator's is Unicode; they agree unless a
# name touches a non-ASCII letter. On the driver data no name occurs, so this pins that
# untouched rows come back unchanged; the diffs below hold names of one word and of several.
@register("doc_mask_persons", _persons_oracle())
def doc_mask_persons(spark, sf_dir):
    """Dictionary names -> <PERSON> on documents (in the row)."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "text")
    m = PV.mask_persons(d, "text", "doc_id", PV.person_names(spark))
    return m.select("doc_id", F.length("text").cast("bigint").alias("masked_len"), F.md5("text").alias("masked_md5"))


@register("diff_mask_persons", f"""WITH {O.F0},
m AS (SELECT pr_id, regexp_replace(diff, {_NAMES}, '<PERSON>', 'g') AS masked FROM prs)
SELECT pr_id, CAST(length(masked) AS BIGINT) AS masked_len, md5(masked) AS masked_md5 FROM m""")
def diff_mask_persons(spark, sf_dir):
    """C8 on whole diffs, whose added lines hold names."""
    m = PV.mask_persons(fx.prs(spark, sf_dir), "diff", "pr_id", PV.person_names(spark))
    return m.select("pr_id", F.length("diff").cast("bigint").alias("masked_len"), F.md5("diff").alias("masked_md5"))


@register("sanitized_diffs", f"""WITH {O.F0},
src AS (SELECT pr_id, {O.filtered('diff')} AS capped FROM prs),
{O.mask_chain_ctes('src', 'pr_id, capped', 'capped', 'm')},
s AS (SELECT pr_id, CASE WHEN capped = '' THEN '' ELSE {O.mask_secrets('t7')} END AS sanitized FROM m)
SELECT pr_id, CAST(length(sanitized) AS BIGINT) AS sanitized_len, md5(sanitized) AS sanitized_md5 FROM s""")
def sanitized_diffs(spark, sf_dir):
    """The full model-facing diff: guardrail, all entities, secrets, fail-closed."""
    s = PV.sanitize(D.guard_diff(fx.prs(spark, sf_dir)))
    return s.select("pr_id", F.length("sanitized_diff").cast("bigint").alias("sanitized_len"),
                    F.md5("sanitized_diff").alias("sanitized_md5"))


def _rules_values() -> str:
    return ", ".join(f"({O.q(r)}, {O.q(t)}, {O.q(s)}, {O.q(p)})" for r, t, s, p in PV.SECRET_RULES)


_FINDINGS_SQL = f"""rules AS (SELECT * FROM (VALUES {_rules_values()}) AS t(rule_id, tool, severity, pattern)),
fnd AS (SELECT pr_id, tool, rule_id, severity, path, CAST(coalesce(new_line, 0) AS BIGINT) AS line
  FROM lines, rules WHERE sign IN ('+', '-', ' ') AND regexp_matches(text, pattern))"""


def _findings_oracle(tail: str) -> str:
    from .q_diffs import _LINES_SQL
    return f"WITH {O.F0}, {_LINES_SQL}, {_FINDINGS_SQL} {tail}"


@register("secret_findings", _findings_oracle("SELECT * FROM fnd"))
def secret_findings(spark, sf_dir):
    """C14: rule hits on raw diff lines (rule, file, line; never the matched text)."""
    return ReviewContext(spark, sf_dir).scan_hits


@register("scan_summary", _findings_oracle(f""",
hf AS (SELECT * FROM fnd WHERE upper(severity) IN ('HIGH', 'CRITICAL')),
pt AS (SELECT pr_id, tool, CASE tool WHEN 'Gitleaks' THEN 1 WHEN 'Trivy' THEN 2 ELSE 0 END AS o,
  string_agg(concat_ws(' ', severity, rule_id, concat(path, ':', CAST(line AS VARCHAR))), chr(10)
    ORDER BY path, line, rule_id, severity) AS body FROM hf GROUP BY pr_id, tool),
pp AS (SELECT pr_id, string_agg(concat('=== ', tool, ' findings ===', chr(10), body), chr(10) || chr(10) ORDER BY o)
  AS scan_summary, CAST(count(*) AS BIGINT) AS n_tools FROM pt GROUP BY pr_id)
SELECT prs.pr_id, coalesce(scan_summary, '') AS scan_summary, coalesce(n_tools, 0) AS n_tools
FROM prs LEFT JOIN pp ON prs.pr_id = pp.pr_id"""))
def scan_summary(spark, sf_dir):
    """C15 + C16: HIGH/CRITICAL hits rendered as per-tool sections per PR ('' if none)."""
    return ReviewContext(spark, sf_dir).scans
