"""Registered queries over report assembly (G), the large-PR rule (B5), the result
document (A7) and audit rows (A8)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import contracts as C
from ..operators import intake as I
from ..operators import report as G
from ..session import scratch_path
from ..sources import io
from ..sources.tables import read_table
from . import oracle_fixtures as O
from .catalog import ORACLES, register
from .context import ReviewContext
from .q_contracts import prompt_table

REPORT_TS = "2024-01-01 00:00 UTC"
#: every field of the nested results, by agent
RESULT_FIELDS = {
    "security": ["error", "status", "agent", "severity_level", "findings_summary"],
    "architecture": ["error", "status", "agent", "complexity_score", "refactor_suggestions"],
    "testing": ["error", "status", "agent", "test_coverage_adequate", "qa_notes"],
    "critic": ["error", "status", "agent", "approved_findings", "vetoed_count", "summary"],
}


def final(spark, sf_dir):
    return ReviewContext(spark, sf_dir).final


def reports_df(spark, sf_dir):
    return G.assemble_reports(final(spark, sf_dir), None, REPORT_TS)


@register("large_pr")
def large_pr(spark, sf_dir):
    """Architecture result per PR after the large-PR rule (warn + High Risk note)."""
    r = final(spark, sf_dir).filter(F.col("agent") == "architecture")
    return r.select("pr_id", "n_lines", "large_pr", "outcome", "status",
                    F.size("findings").cast("int").alias("n_findings"))


@register("reports")
def reports(spark, sf_dir):
    """One Markdown report per PR (critic layout, or the fallback when the critic
    timed out) with the governance footer; fixed timestamp for reproducible text."""
    rep = reports_df(spark, sf_dir)
    return rep.select("pr_id", "critic_outcome", F.length("markdown_report").cast("bigint").alias("report_len"),
                      F.md5("markdown_report").alias("report_md5"))


@register("result_documents")
def result_documents(spark, sf_dir):
    """The nested result document per PR (missing agent -> {})."""
    rep = reports_df(spark, sf_dir)
    d = G.result_document(rep)
    at = lambda path: F.get_json_object("document", f"$.{path}")
    return d.select("pr_id", at("pr_id").alias("pr_id_json"), at("summary").alias("summary"),
                    F.md5(at("markdown_report")).alias("report_md5"),
                    *[at(f"results.{a}.{f}").alias(f"{a}_{f}") for a, fs in RESULT_FIELDS.items() for f in fs])


@register("review_requests")
def review_requests(spark, sf_dir):
    """One request per PR and agent: the whole masked diff in payload tags, the scan text for
    security, the three reports as nested JSON for the critic."""
    ctx = ReviewContext(spark, sf_dir)
    r = C.build_requests(ctx.sanitized, prompt_table(spark), ctx.scans, ctx.final)
    return r.select("pr_id", "agent", F.md5("user").alias("user_md5"), F.length("user").cast("bigint").alias("user_len"),
                    "breakout")


@register("audit_rows")
def audit_rows(spark, sf_dir):
    """One audit row per finished review, without any diff column."""
    rep = reports_df(spark, sf_dir)
    return I.audit_rows(rep).select("pr_id", "critic_outcome", "worst_status", "latency_s",
                    F.md5("markdown_report").alias("report_md5"))


# ---------------------------------------------------------------------------
# DuckDB twin of the final results and the Markdown reports.
# ---------------------------------------------------------------------------

def _oracle_results_sql() -> str:
    from .q_contracts import _RESULTS_SQL
    f_ok = ("list_transform(fl, lambda f: {'description': json_extract_string(f, '$.description'), "
            "'file_reference': json_extract_string(f, '$.file_reference'), "
            "'line_number': CAST(CAST(json_extract(f, '$.line_number') AS DOUBLE) AS BIGINT), "
            "'confidence_score': CAST(json_extract(f, '$.confidence_score') AS DOUBLE)})")
    na = ("[{'description': %s, 'file_reference': 'N/A', 'line_number': 0, 'confidence_score': 1.0}]")
    return f"""{_RESULTS_SQL},
spt AS (SELECT pr_id, tool, CASE tool WHEN 'Gitleaks' THEN 1 WHEN 'Trivy' THEN 2 ELSE 0 END AS o,
  string_agg(concat_ws(' ', severity, rule_id, concat(path, ':', CAST(line AS VARCHAR))), chr(10)
    ORDER BY path, line, rule_id, severity) AS body FROM fnd WHERE upper(severity) IN ('HIGH', 'CRITICAL') GROUP BY pr_id, tool),
spp AS (SELECT pr_id, string_agg(concat('=== ', tool, ' findings ===', chr(10), body), chr(10) || chr(10) ORDER BY o)
  AS scan FROM spt GROUP BY pr_id),
grid AS (SELECT p.pr_id, a.agent FROM (SELECT DISTINCT pr_id FROM prs) p,
  (VALUES ('security'), ('architecture'), ('testing'), ('critic')) AS a(agent)),
cj AS (SELECT g.pr_id, g.agent, coalesce(c.outcome, 'failed') AS outcome,
  CASE WHEN c.outcome = 'timeout' THEN 'Timeout' WHEN coalesce(c.outcome, 'failed') = 'failed'
    THEN coalesce(c.last_error, 'no output') END AS error, c.j, coalesce(r.elapsed_s, 0.0) AS elapsed_s
  FROM grid g LEFT JOIN chosen c ON g.pr_id = c.pr_id AND g.agent = c.agent
  LEFT JOIN resolved2 r ON g.pr_id = r.pr_id AND g.agent = r.agent),
fr AS (SELECT cj.*, spp.scan,
  CASE WHEN outcome = 'timeout' THEN 'fail' WHEN outcome = 'failed' THEN CASE WHEN agent = 'testing' THEN 'warn' ELSE 'fail' END
    ELSE coalesce(json_extract_string(j, '$.status'), json_extract_string(j, '$.overall_status')) END AS status,
  CASE WHEN outcome = 'failed' AND agent = 'security' THEN CASE WHEN spp.scan IS NOT NULL THEN 'high' ELSE 'unknown' END
    WHEN outcome = 'ok' THEN json_extract_string(j, '$.severity_level') END AS severity_level,
  CASE WHEN outcome = 'failed' AND agent = 'architecture' THEN 1
    WHEN outcome = 'ok' THEN CAST(CAST(json_extract(j, '$.complexity_score') AS DOUBLE) AS BIGINT) END AS complexity_score,
  CASE WHEN outcome = 'failed' AND agent = 'testing' THEN false
    WHEN outcome = 'ok' THEN CAST(json_extract(j, '$.test_coverage_adequate') AS BOOLEAN) END AS coverage,
  CASE WHEN outcome = 'failed' AND agent = 'critic' THEN 0
    WHEN outcome = 'ok' THEN CAST(CAST(json_extract(j, '$.vetoed_count') AS DOUBLE) AS BIGINT) END AS vetoed_count,
  CASE WHEN outcome = 'failed' AND agent = 'critic' THEN concat('Critic validation failed: ', error)
    WHEN outcome = 'ok' THEN json_extract_string(j, '$.summary') END AS summary,
  CASE WHEN outcome = 'ok' THEN CASE agent WHEN 'security' THEN json_extract(j, '$.findings_summary[*]')
    WHEN 'architecture' THEN json_extract(j, '$.refactor_suggestions[*]') WHEN 'testing' THEN json_extract(j, '$.qa_notes[*]')
    ELSE json_extract(j, '$.approved_findings[*]') END END AS fl
  FROM cj LEFT JOIN spp ON cj.pr_id = spp.pr_id),
fr2 AS (SELECT *, CASE WHEN outcome = 'ok' THEN {f_ok}
  WHEN outcome = 'failed' THEN CASE agent
    WHEN 'security' THEN {na % "CASE WHEN scan IS NOT NULL THEN concat('LLM call failed; deterministic scan results follow: ', scan) ELSE concat('Security scan failed: ', error) END"}
    WHEN 'architecture' THEN {na % "concat('Architecture review failed: ', error)"}
    WHEN 'testing' THEN {na % "concat('Testing evaluation failed: ', error)"}
    ELSE [] END END AS findings FROM fr),
src AS (SELECT pr_id, {O.filtered('diff')} AS capped FROM prs),
{O.mask_chain_ctes('src', 'pr_id, capped', 'capped', 'm')},
san AS (SELECT pr_id, CASE WHEN capped = '' THEN '' ELSE {O.mask_secrets('t7')} END AS d FROM m),
nlines AS (SELECT pr_id, CAST(CASE WHEN d = '' THEN 0 ELSE len(string_split(regexp_replace(d, '\\n$', ''), chr(10))) END
  AS INTEGER) AS n_lines
  FROM san),
final AS (SELECT fr2.* REPLACE (
    CASE WHEN agent = 'architecture' AND outcome <> 'timeout' AND n_lines > {P.LARGE_PR_THRESHOLD} AND status = 'pass' THEN 'warn'
      ELSE status END AS status,
    CASE WHEN agent = 'architecture' AND outcome <> 'timeout' AND n_lines > {P.LARGE_PR_THRESHOLD}
      THEN list_append(coalesce(findings, []), {{'description': {O.q(P.LARGE_PR_NOTE)}, 'file_reference': 'N/A',
        'line_number': 0, 'confidence_score': 1.0}}) ELSE findings END AS findings),
  n_lines, agent = 'architecture' AND outcome <> 'timeout' AND n_lines > {P.LARGE_PR_THRESHOLD} AS large_pr
  FROM fr2 LEFT JOIN nlines ON fr2.pr_id = nlines.pr_id)"""


def _oracle_reports_sql() -> str:
    q = O.q
    badge = ("(CASE lower({s}) WHEN 'pass' THEN '✅ Pass' WHEN 'warn' THEN '⚠️ Warn' WHEN 'fail' THEN '❌ Fail' "
             "ELSE concat('❓ ', {s}) END)")
    rank = "(CASE lower({s}) WHEN 'pass' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END)"
    fmt = ("concat_ws(' — ', coalesce(x.description, ''), CASE WHEN coalesce(x.file_reference, '') <> '' THEN "
           "concat('`', x.file_reference, '`', CASE WHEN coalesce(x.line_number, 0) <> 0 THEN concat(' line ', "
           "CAST(x.line_number AS VARCHAR)) ELSE '' END) END, CASE WHEN x.confidence_score IS NOT NULL THEN "
           "concat('confidence: ', CAST(CAST(round_even(x.confidence_score * 100, 0) AS BIGINT) AS VARCHAR), '%') END)")
    bullets = ("(CASE WHEN coalesce(len({a}), 0) = 0 THEN '_None_' || chr(10) ELSE concat(array_to_string("
               f"list_transform({{a}}, lambda x: concat('- ', {fmt})), chr(10)), chr(10)) END)")
    row = ("concat('| `', coalesce(x.file_reference, 'unknown'), '` | ', CAST(coalesce(x.line_number, 0) AS VARCHAR), ' | ', "
           "CAST(CAST(round_even(coalesce(x.confidence_score, 0.0) * 100, 0) AS BIGINT) AS VARCHAR), '% | ', "
           "coalesce(x.description, ''), ' |')")
    ts = REPORT_TS
    gen = G.DEFAULT_GENERATOR
    nl = "chr(10)"
    s1, s2, s3 = "coalesce(sec.status, 'fail')", "coalesce(arch.status, 'fail')", "coalesce(tst.status, 'fail')"
    worst = (f"CASE WHEN {rank.format(s=s1)} >= greatest({rank.format(s=s2)}, {rank.format(s=s3)}) THEN {s1} "
             f"WHEN {rank.format(s=s2)} >= {rank.format(s=s3)} THEN {s2} ELSE {s3} END")
    pct = "concat(CAST(CAST(round_even({m} * 100, 0) AS BIGINT) AS VARCHAR), '%')"
    fallback = f"""concat({q(G.TITLE)}, CAST(p.pr_id AS VARCHAR), {q(chr(10) + chr(10) + '> **Overall result: ')},
  {badge.format(s='(' + worst + ')')}, {q('** &nbsp;|&nbsp; _' + ts + '_' + chr(10) + chr(10) + '---' + chr(10) + chr(10) + '### 🔒 Security Analysis &nbsp;')},
  {badge.format(s=s1)}, {q(chr(10) + chr(10) + '| Field | Value |' + chr(10) + '|---|---|' + chr(10) + '| **Status** | ')}, {badge.format(s=s1)},
  {q(' |' + chr(10) + '| **Severity Level** | `')}, coalesce(sec.severity_level, 'unknown'),
  {q('` |' + chr(10) + chr(10) + '**Findings:**' + chr(10))}, {bullets.format(a='sec.findings')},
  {q(chr(10) + '---' + chr(10) + chr(10) + '### 🏛️ Architecture Review &nbsp;')}, {badge.format(s=s2)},
  {q(chr(10) + chr(10) + '| Field | Value |' + chr(10) + '|---|---|' + chr(10) + '| **Status** | ')}, {badge.format(s=s2)},
  {q(' |' + chr(10) + '| **Complexity Score** | `')}, coalesce(CAST(arch.complexity_score AS VARCHAR), 'N/A'),
  {q(' / 10` |' + chr(10) + chr(10) + '**Refactor Suggestions:**' + chr(10))}, {bullets.format(a='arch.findings')},
  {q(chr(10) + '---' + chr(10) + chr(10) + '### 🧪 Testing Evaluation &nbsp;')}, {badge.format(s=s3)},
  {q(chr(10) + chr(10) + '| Field | Value |' + chr(10) + '|---|---|' + chr(10) + '| **Status** | ')}, {badge.format(s=s3)},
  {q(' |' + chr(10) + '| **Coverage** | ')}, CASE WHEN coalesce(tst.coverage, false) THEN {q(G.COVERAGE_OK)} ELSE {q(G.COVERAGE_BAD)} END,
  {q(' |' + chr(10) + chr(10) + '**QA Notes:**' + chr(10))}, {bullets.format(a='tst.findings')},
  {q(chr(10) + '---' + chr(10) + chr(10) + '<sub>Generated by ' + gen + ' · ' + ts + '</sub>' + chr(10))},
  CASE WHEN mc.mean_confidence IS NOT NULL THEN concat({q(G.METRICS_HEAD)}, '| **Mean Confidence Score** | `',
    {pct.format(m='mc.mean_confidence')}, '` |', {nl}) ELSE '' END)"""
    critic = f"""concat({q(G.TITLE)}, CAST(p.pr_id AS VARCHAR), {q(chr(10) + chr(10) + '> **Overall verdict: ')},
  {badge.format(s="lower(coalesce(cr.status, 'fail'))")}, {q('**' + chr(10) + chr(10))},
  CASE WHEN coalesce(cr.vetoed_count, 0) > 0 THEN concat('> 🧹 **', CAST(cr.vetoed_count AS VARCHAR), {q(G.VETO_NOTE)})
    ELSE {q(G.CONFIRMED_NOTE)} END,
  {q(chr(10) + '---' + chr(10) + chr(10) + '### 📋 Approved Findings' + chr(10) + chr(10))},
  CASE WHEN coalesce(len(cr.findings), 0) > 0 THEN concat({q(G.FINDINGS_TABLE_HEAD)},
    array_to_string(list_transform(cr.findings, lambda x: {row}), chr(10))) ELSE {q(G.NO_FINDINGS)} END,
  {q(chr(10) + chr(10) + '---' + chr(10) + chr(10) + '### 💬 Lead Reviewer Summary' + chr(10) + chr(10))},
  coalesce(cr.summary, ''),
  {q(chr(10) + chr(10) + '---' + chr(10) + chr(10) + '<sub>Generated by ' + gen + ' · Critic (Lead Reviewer) stage</sub>' + chr(10))})"""
    return f"""WITH {_oracle_results_sql()},
lat AS (SELECT pr_id, coalesce(max(CASE WHEN agent IN ('security', 'architecture', 'testing') THEN least(elapsed_s, 40.0) END), 0.0)
  + coalesce(max(CASE WHEN agent = 'critic' THEN least(elapsed_s, 40.0) END), 0.0) AS latency_s FROM final GROUP BY pr_id),
mc AS (SELECT pr_id, CASE WHEN outcome = 'ok' AND len(findings) > 0 THEN
  list_sum(list_transform(findings, lambda x: coalesce(x.confidence_score, 0.0))) / len(findings) END AS mean_confidence
  FROM final WHERE agent = 'critic'),
p AS (SELECT DISTINCT pr_id FROM final),
md0 AS (SELECT p.pr_id, cr.outcome AS critic_outcome, mc.mean_confidence, lat.latency_s,
  CASE WHEN cr.outcome = 'ok' THEN {critic} WHEN cr.outcome = 'failed' THEN concat('_', cr.summary, '_')
    ELSE {fallback} END AS md
  FROM p JOIN final sec ON sec.pr_id = p.pr_id AND sec.agent = 'security'
  JOIN final arch ON arch.pr_id = p.pr_id AND arch.agent = 'architecture'
  JOIN final tst ON tst.pr_id = p.pr_id AND tst.agent = 'testing'
  JOIN final cr ON cr.pr_id = p.pr_id AND cr.agent = 'critic'
  JOIN mc ON mc.pr_id = p.pr_id JOIN lat ON lat.pr_id = p.pr_id),
md AS (SELECT *, CASE WHEN md <> '' AND NOT contains(md, {q(G.METRICS_MARKER)}) THEN concat(regexp_replace(md, '\\s+$', ''),
  {nl}, {q(G.METRICS_HEAD)}, '| **Pipeline Latency** | `', printf('%.2f', latency_s), 's` |', {nl},
  '| **Estimated LLM Cost** | `$', printf('%.4f', latency_s * {P.COST_PER_SECOND_USD}), '` |',
  CASE WHEN mean_confidence IS NOT NULL THEN concat({nl}, '| **Mean Confidence Score** | `', {pct.format(m='mean_confidence')}, '` |')
    ELSE '' END, {nl}) ELSE md END AS markdown_report FROM md0)"""



ORACLES["large_pr"] = f"""WITH {_oracle_results_sql()}
SELECT pr_id, n_lines, large_pr, outcome, status, CAST(len(findings) AS INTEGER) AS n_findings FROM final
WHERE agent = 'architecture'"""
ORACLES["reports"] = f"""{_oracle_reports_sql()}
SELECT pr_id, critic_outcome, CAST(length(markdown_report) AS BIGINT) AS report_len, md5(markdown_report) AS report_md5 FROM md"""
ORACLES["audit_rows"] = f"""{_oracle_reports_sql()},
w AS (SELECT pr_id, arg_max(status, (CASE lower(status) WHEN 'pass' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END) * 10
  - CASE agent WHEN 'security' THEN 1 WHEN 'architecture' THEN 2 ELSE 3 END) AS worst_status FROM final
  WHERE agent IN ('security', 'architecture', 'testing') GROUP BY pr_id)
SELECT md.pr_id, critic_outcome, worst_status, latency_s, md5(markdown_report) AS report_md5 FROM md JOIN w ON md.pr_id = w.pr_id"""

def _result_fields_sql() -> str:
    """The nested fields as JSON texts, from the final results' columns."""
    own = {"severity_level": "{t}.severity_level", "complexity_score": "CAST({t}.complexity_score AS VARCHAR)",
           "test_coverage_adequate": "CAST({t}.coverage AS VARCHAR)", "vetoed_count": "CAST({t}.vetoed_count AS VARCHAR)",
           "summary": "{t}.summary"}
    cols = []
    for agent, fields in RESULT_FIELDS.items():
        t = {"security": "s", "architecture": "a", "testing": "t", "critic": "c"}[agent]
        late = f"{t}.outcome = 'timeout'"
        for f in fields:
            if f == "status":
                x = f"{t}.status"
            elif f in ("error", "agent"):
                x = f"CASE WHEN {late} THEN {t}.{f} END"
            else:
                x = f"CASE WHEN NOT {late} THEN {own.get(f, 'CAST(to_json({t}.findings) AS VARCHAR)').format(t=t)} END"
            cols.append(f"{x} AS {agent}_{f}")
    return ", ".join(cols)


ORACLES["result_documents"] = f"""{_oracle_reports_sql()}
SELECT md.pr_id, CAST(md.pr_id AS VARCHAR) AS pr_id_json, {O.q(G.DEFAULT_SUMMARY)} AS summary, md5(markdown_report) AS report_md5,
  {_result_fields_sql()}
FROM md JOIN final c ON c.pr_id = md.pr_id AND c.agent = 'critic' JOIN final s ON s.pr_id = md.pr_id AND s.agent = 'security'
  JOIN final a ON a.pr_id = md.pr_id AND a.agent = 'architecture' JOIN final t ON t.pr_id = md.pr_id AND t.agent = 'testing'"""


def _requests_sql() -> str:
    late = "to_json({'error': {t}.error, 'status': {t}.status, 'agent': {t}.agent})"
    own = {"sec": "to_json({'status': sec.status, 'severity_level': sec.severity_level, 'findings_summary': sec.findings})",
           "arch": "to_json({'status': arch.status, 'complexity_score': arch.complexity_score, 'refactor_suggestions': arch.findings})",
           "tst": "to_json({'status': tst.status, 'test_coverage_adequate': tst.coverage, 'qa_notes': tst.findings})"}
    js = {t: f"CAST(CASE WHEN {t}.outcome = 'timeout' THEN {late.replace('{t}', t)} ELSE {x} END AS VARCHAR)" for t, x in own.items()}
    payload = f"concat({O.q(P.PAYLOAD_OPEN + chr(10))}, san.d, {O.q(chr(10) + P.PAYLOAD_CLOSE)})"
    critic = (f"concat({O.q(P.CRITIC_INTRO)}, '{{\"security_agent_output\":', {js['sec']}, ',\"architecture_agent_output\":', "
              f"{js['arch']}, ',\"testing_agent_output\":', {js['tst']}, '}}', "
              f"CASE WHEN san.d <> '' THEN concat({O.q(P.CRITIC_DIFF_INTRO)}, {payload}) ELSE '' END)")
    return f"""WITH {_oracle_results_sql()},
u AS (SELECT san.pr_id, ag.agent, CASE WHEN ag.agent = 'critic' THEN {critic}
  WHEN ag.agent = 'security' AND spp.scan IS NOT NULL THEN concat({payload}, {O.q(P.SCAN_PREAMBLE)}, spp.scan)
  ELSE {payload} END AS "user", contains(san.d, {O.q(P.PAYLOAD_CLOSE)}) AS breakout
  FROM san JOIN final sec ON sec.pr_id = san.pr_id AND sec.agent = 'security'
  JOIN final arch ON arch.pr_id = san.pr_id AND arch.agent = 'architecture'
  JOIN final tst ON tst.pr_id = san.pr_id AND tst.agent = 'testing' LEFT JOIN spp ON spp.pr_id = san.pr_id,
  (VALUES ('security'), ('architecture'), ('testing'), ('critic')) AS ag(agent))
SELECT pr_id, agent, md5("user") AS user_md5, CAST(length("user") AS BIGINT) AS user_len, breakout FROM u"""


ORACLES["review_requests"] = _requests_sql()


AUDIT_FIELDS = "pr_id BIGINT, critic_outcome STRING, worst_status STRING, latency_s DOUBLE, report_md5 STRING"


@register("audit_log", ORACLES["audit_rows"])
def audit_log(spark, sf_dir):
    """A8 sink: the audit rows committed as one run, written again, and read back from their JSON. The
    reviews are made once: both commits take their rows from a written table."""
    path = scratch_path(spark, "audit")
    audit_rows(spark, sf_dir).write.parquet(f"{path}-rows")
    rows = spark.read.parquet(f"{path}-rows")
    for _ in range(2):
        io.write_audit(rows, path, run_id="nightly")
    return io.read_runs(spark, path).select(F.from_json("audit_json", AUDIT_FIELDS).alias("a")).select("a.*")


def _loose_oracle() -> str:
    percent = "concat(coalesce(CAST(round_even(TRY_CAST(json_extract_string(f, '$.confidence_score') AS DOUBLE) * 100, 0) AS BIGINT), 0), '%')"
    return f"""WITH d AS (SELECT doc_id // 4 AS pr_id, doc_id, CAST({O.q(LOOSE_FINDINGS)} AS JSON) AS all_f FROM documents),
l AS (SELECT pr_id, doc_id, i AS ord, json_extract(all_f, '$[' || ((doc_id + i) % {len(json.loads(LOOSE_FINDINGS))}) || ']') AS f
  FROM d, range(3) AS t(i) WHERE i < doc_id % 4)
SELECT pr_id, doc_id, CAST(ord AS INTEGER) AS ord, CASE WHEN json_type(f) = 'VARCHAR' THEN json_extract_string(f, '$')
  WHEN json_type(f) <> 'OBJECT' THEN CAST(f AS VARCHAR)
  ELSE concat_ws(' — ', coalesce(json_extract_string(f, '$.description'), ''),
    CASE WHEN coalesce(json_extract_string(f, '$.file_reference'), '') <> '' THEN concat('`', json_extract_string(f, '$.file_reference'), '`',
      CASE WHEN coalesce(CAST(json_extract(f, '$.line_number') AS BIGINT), 0) <> 0 THEN concat(' line ', CAST(json_extract(f, '$.line_number') AS BIGINT)) ELSE '' END) END,
    CASE WHEN json_exists(f, '$.confidence_score') THEN concat('confidence: ', {percent}) END) END AS line FROM l"""


#: findings as unvalidated results have them: plain texts, objects with parts missing, confidences that are no numbers
LOOSE_FINDINGS = json.dumps([
    "a plain text", {"description": "no place", "confidence_score": "high"}, {"description": "full", "file_reference": "a.py", "line_number": 3,
    "confidence_score": 0.125}, {"file_reference": "b.py"}, {"description": "text number", "confidence_score": "0.5"}, 17,
    {"description": "null confidence", "file_reference": "c.py", "line_number": 0, "confidence_score": None}, "", "second — text"])


@register("loose_findings", _loose_oracle())
def loose_findings(spark, sf_dir):
    """D14 + G2 on results that passed no contract: findings of any shape, one line each."""
    d = read_table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("pr_id"), "doc_id")
    everything = F.try_variant_get(F.parse_json(F.lit(LOOSE_FINDINGS)), "$", "array<variant>")
    n = len(json.loads(LOOSE_FINDINGS))
    own = F.transform(F.expr("CASE WHEN doc_id % 4 = 0 THEN cast(array() AS array<int>) ELSE sequence(0, cast(doc_id % 4 AS int) - 1) END"),
                      lambda i: F.get(everything, ((F.col("doc_id") + i) % n).cast("int")))
    x = d.select("pr_id", "doc_id", F.posexplode(C.as_findings(own, "variant")).alias("ord", "f"))
    return x.select("pr_id", "doc_id", "ord", G.format_finding(F.col("f")).alias("line"))
