"""Registered queries over critic (E) and verdict (F) operators: F2 results vetted
against the F0 diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import contracts as C
from ..operators import critic as E
from ..operators import verdict as V
from .catalog import register
from .context import ReviewContext
from .q_contracts import _RESULTS_SQL, agent_results_df


def _ok_findings(results):
    ok = results.filter((F.col("outcome") == "ok") & F.col("agent").isin(*P.REVIEW_AGENTS))
    return C.explode_findings(ok)


def vetted(spark, sf_dir):
    ctx = ReviewContext(spark, sf_dir)
    return E.veto(_ok_findings(ctx.results), ctx.line_ranges)


# The results CTE chain of the contract oracle (it already holds the F0 line table),
# then the findings of 'ok' reviewer reports and their veto against the diff.
_VETTED_SQL = f"""{_RESULTS_SQL},
fo AS (SELECT pr_id, agent, CAST(i AS INTEGER) AS ord, fl[i + 1] AS f FROM results, unnest(range(len(fl))) AS t(i)
  WHERE outcome = 'ok' AND agent IN ('security', 'architecture', 'testing')),
fnd2 AS (SELECT pr_id, agent, ord, json_extract_string(f, '$.description') AS description,
  json_extract_string(f, '$.file_reference') AS file_reference,
  CAST(CAST(json_extract(f, '$.line_number') AS DOUBLE) AS BIGINT) AS line_number,
  CAST(json_extract(f, '$.confidence_score') AS DOUBLE) AS confidence_score FROM fo),
files AS (SELECT DISTINCT pr_id, path FROM lines WHERE path <> ''),
nl AS (SELECT DISTINCT pr_id, path, new_line FROM lines WHERE sign IN ('+', ' ')),
vetted AS (SELECT f.*, CASE
  WHEN f.file_reference NOT IN ('', 'N/A') AND NOT EXISTS (SELECT 1 FROM files WHERE files.pr_id = f.pr_id
    AND files.path = f.file_reference) THEN 'absent_file'
  WHEN f.file_reference NOT IN ('', 'N/A') AND coalesce(f.line_number, 0) > 0 AND NOT EXISTS (SELECT 1 FROM nl
    WHERE nl.pr_id = f.pr_id AND nl.path = f.file_reference AND nl.new_line = f.line_number) THEN 'unlinked_line'
  ELSE 'approved' END AS veto FROM fnd2 f)"""


def _with_lines(sql_tail: str) -> str:
    """The vetted CTE chain followed by ``sql_tail`` (more CTEs after a comma, or a SELECT)."""
    return f"WITH {_VETTED_SQL}{sql_tail}"


@register("vetoed_findings", _with_lines(
    " SELECT pr_id, agent, ord, file_reference, line_number, veto FROM vetted"))
def vetoed_findings(spark, sf_dir):
    """E2 + E3: every reviewer finding tagged approved / absent_file / unlinked_line."""
    return vetted(spark, sf_dir).select("pr_id", "agent", "ord", "file_reference", "line_number", "veto")


@register("merged_findings", _with_lines(""" SELECT pr_id, file_reference, line_number,
  regexp_replace(lower(trim(description)), '\\s+', ' ', 'g') AS norm, min(description) AS description,
  max(confidence_score) AS confidence_score, array_to_string(list_sort(list_distinct(list(agent))), ',') AS agents,
  CAST(count(*) AS BIGINT) AS n_merged FROM vetted WHERE veto = 'approved' GROUP BY ALL"""))
def merged_findings(spark, sf_dir):
    """Approved findings merged across agents on (pr, file, line, normalised text)."""
    return E.merge_duplicates(vetted(spark, sf_dir).filter(F.col("veto") == "approved"))


@register("overlap_islands", _with_lines(f""", x AS (SELECT * FROM vetted WHERE veto = 'approved'
  AND coalesce(line_number, 0) > 0),
g AS (SELECT *, coalesce(line_number - lag(line_number) OVER w > 3, true) AS gap FROM x
  WINDOW w AS (PARTITION BY pr_id, file_reference ORDER BY line_number, agent, description)),
i AS (SELECT *, CAST(sum(CAST(gap AS INTEGER)) OVER (PARTITION BY pr_id, file_reference ORDER BY line_number, agent,
  description ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island FROM g)
SELECT pr_id, file_reference, island, min(line_number) AS first_line, max(line_number) AS last_line,
  CAST(count(*) AS BIGINT) AS n_findings, max(confidence_score) AS confidence_score FROM i GROUP BY ALL"""))
def overlap_islands(spark, sf_dir):
    """E5: approved findings within 3 lines of each other in one file form an island."""
    return E.merge_overlapping(vetted(spark, sf_dir).filter(F.col("veto") == "approved"), k=3)


@register("critic_counts", _with_lines(""" SELECT pr_id, CAST(count(*) FILTER (WHERE veto = 'approved') AS BIGINT) AS approved_count,
  CAST(count(*) FILTER (WHERE veto <> 'approved') AS BIGINT) AS vetoed_count,
  CAST(count(*) FILTER (WHERE veto = 'approved' AND confidence_score < 0.5) AS BIGINT) AS n_hints FROM vetted GROUP BY pr_id"""))
def critic_counts(spark, sf_dir):
    """E7 + E8: approved / vetoed findings per PR and approved hints (confidence < 0.5)."""
    return E.critic_counts(vetted(spark, sf_dir))


@register("downgraded_security", f"""WITH {_RESULTS_SQL}
SELECT r.pr_id, r.severity_level, CASE WHEN lower(r.severity_level) IN ('critical', 'high') AND hf.pr_id IS NULL THEN
  CASE lower(r.severity_level) WHEN 'critical' THEN 'high' ELSE 'medium' END ELSE r.severity_level END AS final_severity,
  lower(r.severity_level) IN ('critical', 'high') AND hf.pr_id IS NULL AS downgraded
FROM results r LEFT JOIN hf ON r.pr_id = hf.pr_id WHERE r.agent = 'security' AND r.outcome = 'ok'""")
def downgraded_security(spark, sf_dir):
    """Unsupported high / critical security severities drop one level."""
    ctx = ReviewContext(spark, sf_dir)
    sec = ctx.results.filter((F.col("agent") == "security") & (F.col("outcome") == "ok"))
    return E.downgrade(sec.select("pr_id", "severity_level"), ctx.scan_hits).select(
        "pr_id", "severity_level", "final_severity", "downgraded")


@register("converged", f"""WITH {_RESULTS_SQL}
SELECT pr_id, max(CASE WHEN agent = 'security' THEN status END) AS security_status,
  max(CASE WHEN agent = 'architecture' THEN status END) AS architecture_status,
  max(CASE WHEN agent = 'testing' THEN status END) AS testing_status,
  max(CASE WHEN agent = 'critic' THEN status END) AS critic_status, CAST(count(*) AS BIGINT) AS n_results
FROM results GROUP BY pr_id""")
def converged(spark, sf_dir):
    """One row per PR with the agents' results side by side."""
    c = E.converge(agent_results_df(spark, sf_dir))
    return c.select("pr_id", *[F.col(f"{a}.status").alias(f"{a}_status") for a in P.ALL_AGENTS], "n_results")


_RANK = "CASE lower(status) WHEN 'pass' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END"


@register("verdicts", f"""WITH {_RESULTS_SQL},
rv AS (SELECT pr_id, status, {_RANK} AS rk, CASE agent WHEN 'security' THEN 1 WHEN 'architecture' THEN 2 ELSE 3 END AS o
  FROM results WHERE agent IN ('security', 'architecture', 'testing')),
sv AS (SELECT pr_id, lower(severity_level) AS s FROM results WHERE agent = 'security'
  AND lower(severity_level) IN ('low', 'medium', 'high', 'critical')),
ms AS (SELECT pr_id, arg_max(s, CASE s WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END) AS max_severity
  FROM sv GROUP BY pr_id),
w AS (SELECT pr_id, arg_max(status, rk * 10 - o) AS worst_status, max(rk) AS worst_rank FROM rv GROUP BY pr_id)
SELECT w.pr_id, worst_status, worst_rank, max_severity FROM w LEFT JOIN ms ON w.pr_id = ms.pr_id""")
def verdicts(spark, sf_dir):
    """F1 + F3: worst reviewer status (ties in agent order) and max security severity."""
    r = agent_results_df(spark, sf_dir)
    w = V.worst_status(r)
    ms = V.max_severity(r.filter(F.col("agent") == "security"), "severity_level")
    return w.join(ms, "pr_id", "left").select("pr_id", "worst_status", "worst_rank", "max_severity")


@register("review_metrics", f"""WITH {_RESULTS_SQL},
lat AS (SELECT pr_id, coalesce(max(CASE WHEN agent IN ('security', 'architecture', 'testing') THEN least(elapsed_s, 40.0) END), 0.0)
  + coalesce(max(CASE WHEN agent = 'critic' THEN least(elapsed_s, 40.0) END), 0.0) AS latency_s FROM resolved2 GROUP BY pr_id),
cf AS (SELECT pr_id, avg(CAST(json_extract(f, '$.confidence_score') AS DOUBLE)) AS mean_confidence
  FROM (SELECT pr_id, unnest(fl) AS f FROM results WHERE agent = 'critic' AND outcome = 'ok') GROUP BY pr_id),
m AS (SELECT lat.pr_id, latency_s, latency_s * {P.COST_PER_SECOND_USD} AS cost_usd, mean_confidence
  FROM lat LEFT JOIN cf ON lat.pr_id = cf.pr_id)
SELECT pr_id, 'latency_s' AS metric, latency_s AS value FROM m
UNION ALL SELECT pr_id, 'cost_usd', cost_usd FROM m
UNION ALL SELECT pr_id, 'mean_confidence', mean_confidence FROM m WHERE mean_confidence IS NOT NULL""")
def review_metrics(spark, sf_dir):
    """F2 + F4 + F5: latency, latency-based cost and the critic's mean confidence."""
    r = agent_results_df(spark, sf_dir)
    critic = r.filter(F.col("agent") == "critic").select("pr_id", "findings")
    return V.review_metrics(V.pipeline_latency(r), V.mean_confidence(critic))
