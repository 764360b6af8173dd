"""Registered queries over model-output contracts (D) on the F2 agent_outputs fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import patterns as P
from ..operators import contracts as C
from ..operators import diffs as D
from ..sources import fixtures as fx
from . import oracle_fixtures as O
from .catalog import register
from .context import ReviewContext

# ---------------------------------------------------------------------------
# DuckDB twin of the contract checks (JSON type names: VARCHAR, UBIGINT, BIGINT,
# DOUBLE, BOOLEAN, NULL, OBJECT, ARRAY).
# ---------------------------------------------------------------------------


def _d_str(j, p):
    return f"coalesce(json_type({j}, '{p}') = 'VARCHAR', false)"


def _d_enum(j, p, vals):
    return f"({_d_str(j, p)} AND json_extract_string({j}, '{p}') IN ({', '.join(O.q(v) for v in vals)}))"


def _d_int(j, p):
    t = f"json_type({j}, '{p}')"
    return (f"coalesce({t} IN ('UBIGINT', 'BIGINT', 'BOOLEAN') OR ({t} = 'DOUBLE' AND "
            f"CAST(json_extract({j}, '{p}') AS DOUBLE) = floor(CAST(json_extract({j}, '{p}') AS DOUBLE))), false)")


def _d_int_val(j, p):
    return (f"CASE WHEN json_type({j}, '{p}') = 'BOOLEAN' THEN CAST(CAST(json_extract({j}, '{p}') AS BOOLEAN) AS BIGINT) "
            f"ELSE CAST(CAST(json_extract({j}, '{p}') AS DOUBLE) AS BIGINT) END")


def _d_float(j, p):
    return f"coalesce(json_type({j}, '{p}') IN ('UBIGINT', 'BIGINT', 'DOUBLE'), false)"


def _d_float_val(j, p):
    return f"CAST(json_extract({j}, '{p}') AS DOUBLE)"


def _d_bool(j, p):
    return f"coalesce(json_type({j}, '{p}') = 'BOOLEAN', false)"


def _d_finding(f):
    return (f"(json_type({f}) = 'OBJECT' AND {_d_str(f, '$.description')} AND {_d_str(f, '$.file_reference')} "
            f"AND {_d_int(f, '$.line_number')} AND {_d_int_val(f, '$.line_number')} >= 0 "
            f"AND {_d_float(f, '$.confidence_score')} AND {_d_float_val(f, '$.confidence_score')} BETWEEN 0.0 AND 1.0)")


def _d_list(j, p):
    return (f"(json_type({j}, '{p}') IS NULL OR (json_type({j}, '{p}') = 'ARRAY' AND "
            f"coalesce(list_bool_and(list_transform(json_extract({j}, '{p}[*]'), lambda fx: {_d_finding('fx')})), true)))")


def _d_checks(agent, j="j"):
    lst, _ = C.AGENT_FIELDS[agent]
    if agent == "security":
        return [("status", _d_enum(j, "$.status", P.SECURITY_STATUSES)),
                ("severity_level", _d_enum(j, "$.severity_level", P.SEVERITY_LEVELS)), (lst, _d_list(j, f"$.{lst}"))]
    if agent == "architecture":
        return [("status", _d_enum(j, "$.status", P.ARCHITECTURE_STATUSES)),
                ("complexity_score", f"({_d_int(j, '$.complexity_score')} AND {_d_int_val(j, '$.complexity_score')} "
                                     f"BETWEEN 1 AND 10)"), (lst, _d_list(j, f"$.{lst}"))]
    if agent == "testing":
        return [("status", _d_enum(j, "$.status", P.TESTING_STATUSES)),
                ("test_coverage_adequate", _d_bool(j, "$.test_coverage_adequate")), (lst, _d_list(j, f"$.{lst}"))]
    m = "$.mean_confidence_score"
    return [("overall_status", _d_enum(j, "$.overall_status", P.CRITIC_STATUSES)), (lst, _d_list(j, f"$.{lst}")),
            ("vetoed_count", f"({_d_int(j, '$.vetoed_count')} AND {_d_int_val(j, '$.vetoed_count')} >= 0)"),
            ("summary", _d_str(j, "$.summary")),
            ("mean_confidence_score", f"(json_type({j}, '{m}') IS NULL OR json_type({j}, '{m}') = 'NULL' OR "
                                      f"({_d_float(j, m)} AND {_d_float_val(j, m)} BETWEEN 0.0 AND 1.0))")]


def _d_reason(j="j"):
    arms = []
    for agent in C.AGENT_FIELDS:
        inner = " ".join(f"WHEN NOT {pred} THEN 'field {field}'" for field, pred in _d_checks(agent, j))
        arms.append(f"WHEN agent = '{agent}' THEN (CASE WHEN json_type({j}) <> 'OBJECT' THEN 'not an object' {inner} END)")
    return "CASE " + " ".join(arms) + " END"


_FENCE = O.q(J.FENCE)
VALIDATED_SQL = f"""{O.F2},
v0 AS (SELECT *, CASE WHEN regexp_matches(raw_text, {_FENCE}) THEN regexp_extract(raw_text, {_FENCE}, 1)
  ELSE regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g') END AS cleaned FROM agent_outputs),
v1 AS (SELECT *, CASE WHEN json_valid(plain) THEN CAST(plain AS JSON) END AS j
  FROM (SELECT *, replace(cleaned, '[NaN,"NaN",-Infinity]', '[null,"NaN",null]') AS plain FROM v0)),
v2 AS (SELECT *, error IS NULL OR regexp_matches(error, '429|500|502|503|504') OR coalesce(error_type = 'timeout', false)
    OR error IN ('ReadTimeout: timed out', 'ValueError: empty choices') AS retryable,
  CASE WHEN error IS NOT NULL THEN error WHEN j IS NULL THEN concat('LLM returned non-JSON content', chr(10), '---', chr(10), substr(cleaned, 1, 200))
  WHEN ({_d_reason()}) IS NOT NULL THEN concat('LLM output failed validation (', agent, '): ', {_d_reason()}) END AS reason FROM v1),
validated AS (SELECT *, reason IS NULL AS valid FROM v2)"""


def validated(spark, sf_dir):
    return ReviewContext(spark, sf_dir).validated


@register("report_validation", f"""WITH {VALIDATED_SQL}
SELECT pr_id, agent, attempt, valid, reason FROM validated""")
def report_validation(spark, sf_dir):
    """Every landed attempt with its verdict and the first failing rule."""
    return validated(spark, sf_dir).select("pr_id", "agent", "attempt", "valid", "reason")


@register("report_rejects", f"""WITH {VALIDATED_SQL}
SELECT agent, CASE WHEN j IS NULL THEN 'json' ELSE split_part(reason, ': ', 2) END AS reject_kind,
  CAST(count(*) AS BIGINT) AS n FROM validated WHERE NOT valid GROUP BY ALL""")
def report_rejects(spark, sf_dir):
    """D8 quarantine rolled up: rejected reports per agent and first failing rule."""
    v = validated(spark, sf_dir).filter(~F.col("valid"))
    kind = F.when(F.col("payload").isNull(), F.lit("json")).otherwise(F.split_part("reason", F.lit(": "), F.lit(2)))
    return v.groupBy("agent", kind.alias("reject_kind")).agg(F.count("*").cast("bigint").alias("n"))


_RESOLVED_SQL = f"""{VALIDATED_SQL},
ra AS (SELECT *, CASE WHEN provider = 'primary' THEN 0 ELSE 1 END AS prank FROM validated),
r0 AS (SELECT *, attempt <= {P.MAX_RETRIES} AND provider = 'primary' AND NOT coalesce(bool_or(NOT valid AND NOT retryable) OVER
  (PARTITION BY pr_id, agent ORDER BY prank, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS primary_made FROM ra),
r1 AS (SELECT *,
  coalesce(max(CASE WHEN primary_made AND valid THEN 1 ELSE 0 END) OVER w, 0) = 1 AS valid_before,
  coalesce(max(prank) OVER w, 0) = 1 AS fb_before FROM r0
  WINDOW w AS (PARTITION BY pr_id, agent ORDER BY prank, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r2 AS (SELECT *, (primary_made AND NOT valid_before) OR (prank = 1 AND NOT valid_before AND NOT fb_before) AS made FROM r1),
r3 AS (SELECT *, sum(CASE WHEN made THEN latency_s ELSE 0.0 END) OVER (PARTITION BY pr_id, agent ORDER BY prank, attempt
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_latency FROM r2),
resolved AS (SELECT pr_id, agent,
  min(CASE WHEN made AND valid THEN prank * 1000000 + attempt END) AS chosen_key,
  arg_min(attempt, CASE WHEN made AND valid THEN prank * 1000000 + attempt END) AS attempt_used,
  CAST(count(*) FILTER (WHERE made) AS INTEGER) AS attempts_made,
  coalesce(max(CASE WHEN made THEN cum_latency END), 0.0) AS elapsed_s,
  arg_max(reason, CASE WHEN made AND NOT valid THEN prank * 1000000 + attempt END) AS last_error
  FROM r3 GROUP BY pr_id, agent),
resolved2 AS (SELECT *, CASE WHEN elapsed_s > {P.SUBAGENT_TIMEOUT_SECONDS} THEN 'timeout'
  WHEN chosen_key IS NOT NULL THEN 'ok' ELSE 'failed' END AS outcome FROM resolved)"""


def resolved(spark, sf_dir):
    return ReviewContext(spark, sf_dir).resolved


@register("resolved_reports", f"""WITH {_RESOLVED_SQL}
SELECT pr_id, agent, outcome, CASE WHEN chosen_key IS NOT NULL THEN attempt_used END AS attempt_used,
  attempts_made, elapsed_s FROM resolved2""")
def resolved_reports(spark, sf_dir):
    """D10 + D11 + D13: chosen attempt per (PR, agent) with failover and the 40 s SLA."""
    return resolved(spark, sf_dir).select("pr_id", "agent", "outcome", "attempt_used", "attempts_made", "elapsed_s")


@register("attempt_errors", f"""WITH {VALIDATED_SQL}
SELECT pr_id, agent, attempt, CASE WHEN error IS NULL OR error = 'ValueError: empty choices' THEN 'validation'
  WHEN error_type IS NOT NULL THEN error_type WHEN error LIKE 'HTTP %' THEN 'http' WHEN error LIKE 'ReadTimeout%' THEN 'timeout' ELSE 'other' END
  AS error_type, retryable
FROM validated WHERE NOT valid""")
def attempt_errors(spark, sf_dir):
    """Failed attempts classified: parse and contract failures are validation errors, which
    retry, as timeouts do; other failed calls retry by the HTTP code in their message."""
    return validated(spark, sf_dir).filter(~F.col("valid")).select("pr_id", "agent", "attempt", "error_type", "retryable")


def _scan_sql():
    from .q_diffs import _LINES_SQL
    from .q_privacy import _FINDINGS_SQL
    return f"""{O.F0}, {_LINES_SQL}, {_FINDINGS_SQL},
hf AS (SELECT DISTINCT pr_id FROM fnd WHERE upper(severity) IN ('HIGH', 'CRITICAL'))"""


_RESULTS_SQL = f"""{_scan_sql()}, {_RESOLVED_SQL},
chosen AS (SELECT r.pr_id, r.agent, r.outcome, r.last_error, v.j FROM resolved2 r LEFT JOIN r3 v
  ON r.pr_id = v.pr_id AND r.agent = v.agent AND r.chosen_key = v.prank * 1000000 + v.attempt),
results AS (SELECT c.pr_id, c.agent, c.outcome,
  CASE WHEN outcome = 'timeout' THEN 'fail' WHEN outcome = 'failed' THEN CASE WHEN agent = 'testing' THEN 'warn' ELSE 'fail' END
    ELSE coalesce(json_extract_string(j, '$.status'), json_extract_string(j, '$.overall_status')) END AS status,
  CASE WHEN outcome = 'failed' AND agent = 'security' THEN CASE WHEN hf.pr_id IS NOT NULL THEN 'high' ELSE 'unknown' END
    WHEN outcome = 'ok' THEN json_extract_string(j, '$.severity_level') END AS severity_level,
  CAST(CASE WHEN outcome = 'failed' AND agent = 'architecture' THEN 1
    WHEN outcome = 'ok' THEN CAST(json_extract(j, '$.complexity_score') AS DOUBLE) END AS BIGINT) AS complexity_score,
  CASE WHEN outcome = 'failed' AND agent = 'testing' THEN false
    WHEN outcome = 'ok' THEN CAST(json_extract(j, '$.test_coverage_adequate') AS BOOLEAN) END AS test_coverage_adequate,
  CAST(CASE WHEN outcome = 'failed' AND agent = 'critic' THEN 0
    WHEN outcome = 'ok' THEN CAST(json_extract(j, '$.vetoed_count') AS DOUBLE) END AS BIGINT) AS vetoed_count,
  CASE WHEN outcome = 'timeout' THEN 'Timeout' WHEN outcome = 'failed' THEN coalesce(last_error, 'no output') END AS error,
  CASE WHEN outcome = 'ok' THEN CASE agent WHEN 'security' THEN json_extract(j, '$.findings_summary[*]')
    WHEN 'architecture' THEN json_extract(j, '$.refactor_suggestions[*]') WHEN 'testing' THEN json_extract(j, '$.qa_notes[*]')
    ELSE json_extract(j, '$.approved_findings[*]') END END AS fl,
  hf.pr_id IS NOT NULL AS has_scan
  FROM chosen c LEFT JOIN hf ON c.pr_id = hf.pr_id)"""


def agent_results_df(spark, sf_dir, ctx=None):
    return (ctx or ReviewContext(spark, sf_dir)).results


@register("agent_results", f"""WITH {_RESULTS_SQL}
SELECT pr_id, agent, outcome, status, severity_level, complexity_score, test_coverage_adequate, vetoed_count, error,
  CAST(CASE WHEN outcome = 'failed' THEN CASE WHEN agent = 'critic' THEN 0 ELSE 1 END
    WHEN outcome = 'ok' THEN len(fl) END AS INTEGER) AS n_findings FROM results""")
def agent_results(spark, sf_dir):
    """D12 + D13: the final per-agent result: report, timeout row or fixed fallback."""
    r = agent_results_df(spark, sf_dir)
    return r.select("pr_id", "agent", "outcome", "status", "severity_level", "complexity_score",
                    "test_coverage_adequate", "vetoed_count", "error", F.size("findings").cast("int").alias("n_findings"))


@register("exploded_findings", f"""WITH {_RESULTS_SQL},
ok AS (SELECT pr_id, agent, CAST(i AS INTEGER) AS ord, fl[i + 1] AS f FROM results, unnest(range(len(fl))) AS t(i)
  WHERE outcome = 'ok'),
xt AS (SELECT pr_id, tool, string_agg(concat_ws(' ', severity, rule_id, concat(path, ':', CAST(line AS VARCHAR))), chr(10)
    ORDER BY path, line, rule_id, severity) AS body FROM fnd WHERE upper(severity) IN ('HIGH', 'CRITICAL') GROUP BY pr_id, tool),
xs AS (SELECT pr_id, string_agg(concat('=== ', tool, ' findings ===', chr(10), body), chr(10) || chr(10)
    ORDER BY CASE tool WHEN 'Gitleaks' THEN 1 WHEN 'Trivy' THEN 2 ELSE 0 END) AS scan FROM xt GROUP BY pr_id)
SELECT pr_id, agent, ord, json_extract_string(f, '$.description') AS description,
  json_extract_string(f, '$.file_reference') AS file_reference,
  CAST(CAST(json_extract(f, '$.line_number') AS DOUBLE) AS BIGINT) AS line_number,
  CAST(json_extract(f, '$.confidence_score') AS DOUBLE) AS confidence_score FROM ok
UNION ALL
SELECT results.pr_id, agent, 0, CASE agent WHEN 'security' THEN CASE WHEN scan IS NOT NULL
    THEN concat({O.q(P.SECURITY_SCAN_FALLBACK)}, scan) ELSE concat('Security scan failed: ', error) END
  WHEN 'architecture' THEN concat('Architecture review failed: ', error) ELSE concat('Testing evaluation failed: ', error) END,
  'N/A', 0, 1.0 FROM results LEFT JOIN xs ON results.pr_id = xs.pr_id WHERE outcome = 'failed' AND agent <> 'critic'""")
def exploded_findings(spark, sf_dir):
    """Findings of the final results as a long table, fallbacks included."""
    return C.explode_findings(agent_results_df(spark, sf_dir))


DEFAULT_PROMPTS = [
    ("security", "Review the diff for security problems and answer with the security report JSON."),
    ("architecture", "Review the diff for structure and duplication and answer with the architecture report JSON."),
    ("testing", "Review the diff for test quality and answer with the testing report JSON."),
    ("critic", "Cross-check the three reports against the diff and answer with the critic report JSON."),
]


def prompt_table(spark):
    return spark.createDataFrame(DEFAULT_PROMPTS, "agent string, system string")


@register("valid_reports", f"""WITH {VALIDATED_SQL}
SELECT pr_id, agent, attempt,
  CASE WHEN agent = 'critic' THEN json_extract_string(j, '$.overall_status') ELSE json_extract_string(j, '$.status') END
    AS status,
  json_extract_string(j, '$.severity_level') AS severity_level,
  CAST(CAST(json_extract(j, '$.complexity_score') AS DOUBLE) AS BIGINT) AS complexity_score,
  CAST(json_extract(j, '$.test_coverage_adequate') AS BOOLEAN) AS test_coverage_adequate,
  CAST(CAST(json_extract(j, '$.vetoed_count') AS DOUBLE) AS BIGINT) AS vetoed_count,
  CAST(coalesce(json_array_length(j, CASE agent WHEN 'security' THEN '$.findings_summary'
    WHEN 'architecture' THEN '$.refactor_suggestions' WHEN 'testing' THEN '$.qa_notes' ELSE '$.approved_findings' END), 0)
    AS INTEGER) AS n_findings
FROM validated WHERE valid""")
def valid_reports(spark, sf_dir):
    """Reports that passed their contract, as typed columns."""
    v = validated(spark, sf_dir).filter(F.col("valid"))
    return v.select("pr_id", "agent", "attempt", "status", "severity_level", "complexity_score",
                    "test_coverage_adequate", "vetoed_count", F.size("findings").cast("int").alias("n_findings"))
