"""Report assembly (G): badges, finding lines, bullet lists, the critic report, the
fallback per-agent report, report choice and the governance-metrics footer.

One output row per PR: results arrive as one row per (PR, agent) and are pivoted with a
single group-by on ``pr_id``; every renderer below is a column expression inside that
job (``concat`` / ``array_join(transform(...))``), not a per-row tool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .contracts import agent_json, json_object

# ---------------------------------------------------------------------------
# FIXED VALUES: report layout of the reviewed service. The footer's generator name is
# a parameter (ours by default), everything else must match for equal reports.
# ---------------------------------------------------------------------------
TITLE = "## 🤖 Automated Code Review — PR #"
SEP = " — "
NONE_BULLETS = "_None_\n"
NO_FINDINGS = "_No actionable findings after review._"
FINDINGS_TABLE_HEAD = "| File | Line | Confidence | Finding |\n|---|---|---|---|\n"
VETO_NOTE = " finding(s) vetoed** as false positives or AI hallucinations by the Lead Reviewer.\n"
CONFIRMED_NOTE = "> ✨ All upstream findings were confirmed — no false positives detected.\n"
METRICS_HEAD = "\n---\n\n### 📊 Governance Metrics\n\n| Metric | Value |\n|---|---|\n"
METRICS_MARKER = "Governance Metrics"
COVERAGE_OK = "✅ Adequate"
COVERAGE_BAD = "❌ Inadequate"
DEFAULT_GENERATOR = "reviewlake"
DEFAULT_SUMMARY = "Code review completed."


def badge(status: Column, lower_fallback: bool = False) -> Column:
    """G1: pass / warn / fail (any case) -> label; else '❓ <status>'."""
    lc = F.lower(status)
    other = F.concat(F.lit(P.UNKNOWN_BADGE_PREFIX), lc if lower_fallback else status)
    out = other
    for k in reversed(list(P.STATUS_BADGE)):
        out = F.when(lc == k, F.lit(P.STATUS_BADGE[k])).otherwise(out)
    return out


def pct(x: Column) -> Column:
    """'{:.0%}': half-even rounding of x*100, as an integer percent."""
    return F.concat(F.bround(x * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def fixed(x: Column, digits: int) -> Column:
    """'{:.nf}' of a number from 0 below 2^53: rounds the exact binary value, ties to even.

    The fraction of a double is a whole number of 2^-80ths here, held in two 40-bit halves, so
    its decimal digits and what remains below them are exact whole numbers."""
    scale, unit = 10 ** digits, 1 << 80
    half = F.expr(f"cast('{unit // 2}' AS decimal(25,0))")
    unit_lit = F.expr(f"cast('{unit}' AS decimal(25,0))")
    to = lambda c, p: c.cast(f"decimal({p},0)")

    def rounded(whole: Column, scaled: Column, down: Column) -> Column:
        rest = scaled - to(to(down, 8) * unit_lit, 38)
        up = F.when((rest > half) | ((rest == half) & (down % 2 == 1)), F.lit(1)).otherwise(F.lit(0))
        return to(to(whole, 20) * to(F.lit(scale), 6) + down + up, 38).cast("string")

    def text(t: Column) -> Column:
        padded = F.lpad(t, F.greatest(F.length(t), F.lit(digits + 1)), F.lit("0"))
        return F.concat(F.substring(padded, F.lit(1), F.greatest(F.length(t), F.lit(digits + 1)) - digits), F.lit("."),
                        F.right(padded, F.lit(digits)))

    def parts(v: Column) -> Column:
        high = (v - F.floor(v)) * float(1 << 40)
        bits = to(F.floor(high), 13) * to(F.lit(1 << 40), 13) + to(F.floor((high - F.floor(high)) * float(1 << 40)), 13)
        return _bound(to(bits * to(F.lit(scale), 6), 38), lambda s: _bound(
            F.call_function("div", s, unit_lit), lambda d: rounded(F.floor(v), s, d)))

    return _bound(_bound(x, parts), text)


def format_finding(f: Column) -> Column:
    """``desc — `file` line n — confidence: p%``; the location is left out without
    a file, the line without a number, the confidence when missing. A finding that was a
    plain text (see ``contracts.as_findings``) has a description only."""
    loc = F.when(F.coalesce(f["file_reference"], F.lit("")) != "", F.concat(
        F.lit("`"), f["file_reference"], F.lit("`"),
        F.when(F.coalesce(f["line_number"], F.lit(0)) != 0,
               F.concat(F.lit(" line "), f["line_number"].cast("string"))).otherwise(F.lit(""))))
    conf = F.when(f["confidence_score"].isNotNull(), F.concat(F.lit("confidence: "), pct(f["confidence_score"])))
    return F.concat_ws(SEP, F.coalesce(f["description"], F.lit("")), loc, conf)


def bullet_list(arr: Column) -> Column:
    """One '- ' line per finding, '_None_' when empty."""
    return F.when(F.coalesce(F.size(arr), F.lit(0)) <= 0, F.lit(NONE_BULLETS)).otherwise(
        F.concat(F.array_join(F.transform(arr, lambda f: F.concat(F.lit("- "), format_finding(f))), "\n"), F.lit("\n")))


def critic_report(pr_id: Column, status: Column, findings: Column, vetoed: Column, summary: Column,
                  generator: str = DEFAULT_GENERATOR) -> Column:
    """The critic's Markdown (verdict, veto note, findings table, summary)."""
    row = lambda f: F.concat(
        F.lit("| `"), F.coalesce(f["file_reference"], F.lit("unknown")), F.lit("` | "),
        F.coalesce(f["line_number"], F.lit(0)).cast("string"), F.lit(" | "),
        F.bround(F.coalesce(f["confidence_score"], F.lit(0.0)) * 100, 0).cast("bigint").cast("string"),
        F.lit("% | "), F.coalesce(f["description"], F.lit("")), F.lit(" |"))
    table = F.when(F.coalesce(F.size(findings), F.lit(0)) > 0,
                   F.concat(F.lit(FINDINGS_TABLE_HEAD), F.array_join(F.transform(findings, row), "\n"))
                   ).otherwise(F.lit(NO_FINDINGS))
    v = F.coalesce(vetoed, F.lit(0))
    note = F.when(v > 0, F.concat(F.lit("> 🧹 **"), v.cast("string"), F.lit(VETO_NOTE))).otherwise(F.lit(CONFIRMED_NOTE))
    return F.concat(
        F.lit(TITLE), pr_id.cast("string"), F.lit("\n\n> **Overall verdict: "),
        badge(F.lower(F.coalesce(status, F.lit("fail"))), lower_fallback=True), F.lit("**\n\n"), note,
        F.lit("\n---\n\n### 📋 Approved Findings\n\n"), table,
        F.lit("\n\n---\n\n### 💬 Lead Reviewer Summary\n\n"), F.coalesce(summary, F.lit("")),
        F.lit(f"\n\n---\n\n<sub>Generated by {generator} · Critic (Lead Reviewer) stage</sub>\n"))


def _status(s: Column) -> Column:
    return F.coalesce(s, F.lit("fail"))


def agent_report(pr_id: Column, sec, arch, test, ts: str, mean_conf: Column | None = None,
                 generator: str = DEFAULT_GENERATOR) -> Column:
    """The fallback layout from the three reviewer results (structs with status,
    severity_level, complexity_score, test_coverage_adequate, findings). Missing
    severity -> 'unknown', complexity -> 'N/A', coverage not true -> Inadequate; the
    timestamp is an argument so reruns give the same text."""
    rank = lambda s: F.when(F.lower(s) == "pass", 0).when(F.lower(s) == "warn", 1).otherwise(2)
    st = [_status(sec["status"]), _status(arch["status"]), _status(test["status"])]
    worst = F.when(rank(st[0]) >= F.greatest(rank(st[1]), rank(st[2])), st[0]).when(
        rank(st[1]) >= rank(st[2]), st[1]).otherwise(st[2])
    b = [badge(s) for s in st]
    cov = F.when(F.coalesce(test["test_coverage_adequate"], F.lit(False)), F.lit(COVERAGE_OK)).otherwise(F.lit(COVERAGE_BAD))
    body = F.concat(
        F.lit(TITLE), pr_id.cast("string"), F.lit("\n\n> **Overall result: "), badge(worst),
        F.lit(f"** &nbsp;|&nbsp; _{ts}_\n\n---\n\n### 🔒 Security Analysis &nbsp;"), b[0],
        F.lit("\n\n| Field | Value |\n|---|---|\n| **Status** | "), b[0],
        F.lit(" |\n| **Severity Level** | `"), F.coalesce(sec["severity_level"], F.lit("unknown")),
        F.lit("` |\n\n**Findings:**\n"), bullet_list(sec["findings"]),
        F.lit("\n---\n\n### 🏛️ Architecture Review &nbsp;"), b[1],
        F.lit("\n\n| Field | Value |\n|---|---|\n| **Status** | "), b[1],
        F.lit(" |\n| **Complexity Score** | `"), F.coalesce(arch["complexity_score"].cast("string"), F.lit("N/A")),
        F.lit(" / 10` |\n\n**Refactor Suggestions:**\n"), bullet_list(arch["findings"]),
        F.lit("\n---\n\n### 🧪 Testing Evaluation &nbsp;"), b[2],
        F.lit("\n\n| Field | Value |\n|---|---|\n| **Status** | "), b[2],
        F.lit(" |\n| **Coverage** | "), cov,
        F.lit(" |\n\n**QA Notes:**\n"), bullet_list(test["findings"]),
        F.lit(f"\n---\n\n<sub>Generated by {generator} · {ts}</sub>\n"))
    if mean_conf is None:
        return body
    return F.when(mean_conf.isNull(), body).otherwise(F.concat(
        body, F.lit(METRICS_HEAD), F.lit("| **Mean Confidence Score** | `"), pct(mean_conf), F.lit("` |\n")))


def append_metrics(md: Column, latency: Column, mean_conf: Column) -> Column:
    """Add the governance footer unless the text already has one; the text is
    right-stripped of Unicode whitespace first (``rtrim`` strips spaces only)."""
    rows = F.concat(
        F.lit("| **Pipeline Latency** | `"), fixed(latency, 2), F.lit("s` |\n"),
        F.lit("| **Estimated LLM Cost** | `$"), fixed(latency * F.lit(P.COST_PER_SECOND_USD), 4),
        F.lit("` |"),
        F.when(mean_conf.isNotNull(), F.concat(F.lit("\n| **Mean Confidence Score** | `"), pct(mean_conf), F.lit("` |")))
        .otherwise(F.lit("")), F.lit("\n"))
    add = (F.coalesce(md, F.lit("")) != "") & ~F.coalesce(md, F.lit("")).contains(METRICS_MARKER)
    stripped = F.regexp_replace(md, r"(?U)\s+\z", "")
    return F.when(add, F.concat(stripped, F.lit("\n"), F.lit(METRICS_HEAD), rows)).otherwise(F.coalesce(md, F.lit("")))


def assemble_reports(results: DataFrame, latency: DataFrame | None, ts: str,
                     generator: str = DEFAULT_GENERATOR) -> DataFrame:
    """G4-G7 per PR: pivot the agent results (one group-by on ``pr_id``, which also
    computes the pipeline latency unless ``latency`` is given), render the critic report
    or, when the critic timed out, the fallback layout; then append the metrics footer.
    Output: ``pr_id, critic_outcome, mean_confidence, latency_s, worst_status, documents
    (agent -> JSON of its result), markdown_report``."""
    from .verdict import latency_agg, worst_agg
    cols = ["status", "severity_level", "complexity_score", "test_coverage_adequate", "findings",
            "outcome", "error", "vetoed_count", "summary"]
    aggs = [F.first(F.when(F.col("agent") == a, F.struct(*cols)), ignorenulls=True).alias(a) for a in P.ALL_AGENTS]
    aggs += [F.first(F.when(F.col("agent") == a, agent_json(a)), ignorenulls=True).alias(f"__{a}") for a in P.ALL_AGENTS]
    if latency is None:
        x = results.groupBy("pr_id").agg(*aggs, latency_agg().alias("latency_s"), worst_agg().alias("worst"))
    else:
        x = results.groupBy("pr_id").agg(*aggs, worst_agg().alias("worst")).join(latency, "pr_id", "left")
    cr = F.col("critic")
    approved = F.when(cr["outcome"] == "ok", cr["findings"])
    mean_conf = F.when(F.coalesce(F.size(approved), F.lit(0)) > 0, F.aggregate(
        approved, F.lit(0.0), lambda a, f: a + F.coalesce(f["confidence_score"], F.lit(0.0))) / F.size(approved))
    x = x.withColumn("mean_confidence", mean_conf)
    crit = critic_report(F.col("pr_id"), cr["status"], cr["findings"], cr["vetoed_count"], cr["summary"], generator)
    fallback = agent_report(F.col("pr_id"), F.col("security"), F.col("architecture"), F.col("testing"), ts,
                            F.col("mean_confidence"), generator)
    chosen = (F.when(cr["outcome"] == "ok", crit)
              .when(cr["outcome"] == "failed", F.concat(F.lit("_"), cr["summary"], F.lit("_")))
              .otherwise(fallback))
    x = x.withColumn("md", chosen)
    return x.select("pr_id", cr["outcome"].alias("critic_outcome"), "mean_confidence",
                    F.coalesce(F.col("latency_s"), F.lit(0.0)).alias("latency_s"), F.col("worst.status").alias("worst_status"),
                    json_object({a: F.col(f"__{a}") for a in P.ALL_AGENTS}).alias("documents"),
                    append_metrics(F.col("md"), F.coalesce(F.col("latency_s"), F.lit(0.0)), F.col("mean_confidence"))
                    .alias("markdown_report"))


def result_document(reports: DataFrame, results: DataFrame | None = None, summary: str = DEFAULT_SUMMARY) -> DataFrame:
    """One nested JSON document per PR ``{pr_id, summary, markdown_report, results}``;
    ``pr_id`` keeps its type, a missing agent result is ``{}``. Assembled reports carry their
    ``documents``; for reports from elsewhere ``results`` has the agents' rows."""
    if results is not None:
        piv = results.groupBy("pr_id").agg(*[
            F.first(F.when(F.col("agent") == a, agent_json(a)), ignorenulls=True).alias(f"__{a}") for a in P.ALL_AGENTS])
        reports = reports.join(piv, "pr_id", "left").withColumn("documents", json_object({a: F.col(f"__{a}") for a in P.ALL_AGENTS}))
    head = F.to_json(F.struct(F.col("pr_id"), F.lit(summary).alias("summary"), F.col("markdown_report")))
    full = F.concat(F.expr("substring(__doc, 1, length(__doc) - 1)"), F.lit(',"results":'), F.col("documents"), F.lit("}"))
    return reports.withColumn("__doc", head).select("pr_id", F.lit(summary).alias("summary"), "markdown_report",
                                                    full.alias("document"))
