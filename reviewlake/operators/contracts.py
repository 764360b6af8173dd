"""Model-output contracts (D): fence strip, strict parse, per-agent contract checks,
quarantine, retry classification, attempt resolution with failover, SLA, defaults,
finding explosion and request building.

Validation is column expressions over VARIANT (``try_variant_get`` /
``schema_of_variant`` / ``forall``), so it runs map-side. Attempt resolution is one
aggregation on ``(pr_id, agent)`` and a fold over each key's few attempts, so the log is
shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import patterns as P

FINDING_TYPE = "struct<description:string,file_reference:string,line_number:bigint,confidence_score:double>"
FINDINGS_TYPE = f"array<{FINDING_TYPE}>"

# Report fields per agent: (findings list field, status field).
AGENT_FIELDS = {
    "security": ("findings_summary", "status"),
    "architecture": ("refactor_suggestions", "status"),
    "testing": ("qa_notes", "status"),
    "critic": ("approved_findings", "overall_status"),
}


def _in(values) -> str:
    return "(" + ", ".join(J.sql_str(v) for v in values) + ")"


# Scalar report fields: name -> JSON path. Extracted once per row into struct columns.
SCALAR_FIELDS = ["status", "overall_status", "severity_level", "complexity_score", "test_coverage_adequate",
                 "vetoed_count", "summary", "mean_confidence_score"]
TEXT_FIELDS = {"status", "overall_status", "severity_level", "summary"}


def _fv(name: str) -> str:
    return f"__f_{name}"


def finding_ok_sql(x: str) -> str:
    """D3 on an extracted finding: object, string description / file_reference, int
    line_number >= 0, float confidence_score in [0, 1]."""
    return (f"(coalesce(startswith({x}.t, 'OBJECT'), false) AND {J.f_is_str(x + '.desc')} AND {J.f_is_str(x + '.file')} "
            f"AND {J.f_is_int(x + '.line')} AND {J.f_int(x + '.line')} >= 0 "
            f"AND {J.f_is_float(x + '.conf')} AND {J.f_float(x + '.conf')} BETWEEN 0.0 AND 1.0)")


def _enum_ok(name: str, values) -> str:
    x = _fv(name)
    return f"({J.f_is_str(x)} AND {x}.s IN {_in(values)})"


def _list_ok() -> str:
    return ("(__list_state = 'missing' OR (__list_state = 'list' AND "
            f"forall(__items, fx -> {finding_ok_sql('fx')})))")


def contract_checks(agent: str) -> list[tuple[str, str]]:
    """Ordered (field, predicate SQL) checks of one agent's contract (D4-D7), over the
    columns added by :func:`_extract`."""
    lst, _ = AGENT_FIELDS[agent]
    if agent == "security":
        return [("status", _enum_ok("status", P.SECURITY_STATUSES)),
                ("severity_level", _enum_ok("severity_level", P.SEVERITY_LEVELS)), (lst, _list_ok())]
    if agent == "architecture":
        c = _fv("complexity_score")
        return [("status", _enum_ok("status", P.ARCHITECTURE_STATUSES)),
                ("complexity_score", f"({J.f_is_int(c)} AND {J.f_int(c)} BETWEEN 1 AND 10)"), (lst, _list_ok())]
    if agent == "testing":
        return [("status", _enum_ok("status", P.TESTING_STATUSES)),
                ("test_coverage_adequate", J.f_is_bool(_fv("test_coverage_adequate"))), (lst, _list_ok())]
    if agent == "critic":
        m, vc = _fv("mean_confidence_score"), _fv("vetoed_count")
        return [("overall_status", _enum_ok("overall_status", P.CRITIC_STATUSES)), (lst, _list_ok()),
                ("vetoed_count", f"({J.f_is_int(vc)} AND {J.f_int(vc)} >= 0)"),
                ("summary", J.f_is_str(_fv("summary"))),
                ("mean_confidence_score", f"({m}.t IS NULL OR {m}.t = 'VOID' OR "
                                          f"({J.f_is_float(m)} AND {J.f_float(m)} BETWEEN 0.0 AND 1.0))")]
    raise ValueError(agent)


def _reason_sql() -> str:
    """First failing check of the row's agent contract, NULL when valid."""
    arms = []
    for agent in AGENT_FIELDS:
        inner = " ".join(f"WHEN NOT {pred} THEN 'field {field}'" for field, pred in contract_checks(agent))
        arms.append(f"WHEN agent = '{agent}' THEN (CASE WHEN NOT __is_obj THEN 'not an object' {inner} END)")
    return "CASE " + " ".join(arms) + " ELSE 'unknown agent' END"


def _extract(df: DataFrame, v: str = "payload") -> DataFrame:
    """Add one struct column per scalar field, the agent's findings list (items and
    state) and per-finding extracted structs. Each VARIANT path is read once."""
    cols = [F.expr(J.field_struct_sql(J.vget(v, "$." + f), f in TEXT_FIELDS)).alias(_fv(f)) for f in SCALAR_FIELDS]
    # One literal path per agent, so each VARIANT path is parsed once per plan, not per row.
    lst = "CASE " + " ".join(f"WHEN agent = '{a}' THEN try_variant_get({v}, '$.{f}', 'variant')"
                             for a, (f, _) in AGENT_FIELDS.items()) + " END"
    x = df.select("*", F.expr(lst).alias("__list"))
    lst = "__list"
    state = (f"CASE WHEN schema_of_variant({lst}) IS NULL THEN 'missing' "
             f"WHEN startswith(schema_of_variant({lst}), 'ARRAY') THEN 'list' ELSE 'bad' END")
    # A finding's fields are read in one step, as a struct of variants.
    fields = "struct<description:variant,file_reference:variant,line_number:variant,confidence_score:variant>"
    items = (f"transform(transform(coalesce(try_variant_get({lst}, '$', 'array<variant>'), array()), fv -> named_struct("
             f"'t', schema_of_variant(fv), 'o', try_variant_get(fv, '$', '{fields}'))), fo -> named_struct("
             f"'t', fo.t, 'desc', {J.field_struct_sql('fo.o.description', True)}, "
             f"'file', {J.field_struct_sql('fo.o.file_reference', True)}, "
             f"'line', {J.field_struct_sql('fo.o.line_number')}, 'conf', {J.field_struct_sql('fo.o.confidence_score')}))")
    return x.select(*df.columns, F.expr(J.is_object(v)).alias("__is_obj"), *cols, F.expr(state).alias("__list_state"),
                    F.expr(items).alias("__items"))


def parse_reports(df: DataFrame, text: str = "raw_text", quoted: int = 200) -> DataFrame:
    """D1 + D2: strip the fence, parse strictly. Adds ``cleaned``, ``payload`` (VARIANT,
    NULL when not JSON) and ``parse_error`` (whose message quotes the first ``quoted`` characters;
    the text itself stays whole in its column)."""
    J.python_json_semantics(df.sparkSession)
    x = df.withColumn("cleaned", F.expr(J.strip_fence_sql(text)))
    payload = F.expr(J.strict_parse_sql("cleaned"))
    err = F.when(payload.isNull(), F.concat(F.lit("LLM returned non-JSON content\n---\n"), F.substring("cleaned", 1, quoted)))
    if "error" in df.columns:  # the call failed, there is no text
        err = F.coalesce(F.col("error"), err)
    # The parse result leaves through a one-row generator so that the many later
    # references to ``payload`` read one computed value instead of re-parsing.
    return x.select(*df.columns, "cleaned", F.inline(F.array(F.struct(payload.alias("payload"), err.alias("parse_error")))))


def validate_reports(df: DataFrame) -> DataFrame:
    """``valid`` and ``reason`` per report, plus typed report columns. One bad
    field or finding rejects the whole report. Needs ``agent`` and ``payload``."""
    x = _extract(df)
    x = x.withColumn("__contract", F.when(F.col("payload").isNotNull(), F.expr(_reason_sql())))
    reason = F.when(F.col("payload").isNull(), F.col("parse_error")).when(
        F.col("__contract").isNotNull(),
        F.concat(F.lit("LLM output failed validation ("), F.col("agent"), F.lit("): "), F.col("__contract")))
    x = x.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
    findings = ("transform(__items, fx -> named_struct('description', fx.desc.s, 'file_reference', fx.file.s, "
                f"'line_number', {J.f_int('fx.line')}, 'confidence_score', {J.f_float('fx.conf')}))")
    st, oc = _fv("status"), _fv("overall_status")
    m = _fv("mean_confidence_score")
    # The typed columns leave through a one-row ``inline`` generator: later filters on
    # ``valid`` cannot be pushed through a Generate, so Catalyst never inlines the whole
    # validation tree into a predicate (that inlining grows with every shared field).
    out = F.struct(
        F.col("reason"), F.col("valid"),
        F.expr(f"CASE WHEN agent = 'critic' THEN {oc}.s ELSE {st}.s END").alias("status"),
        F.expr(f"{_fv('severity_level')}.s").alias("severity_level"),
        F.expr(J.f_int(_fv('complexity_score'))).alias("complexity_score"),
        F.expr(J.f_bool(_fv("test_coverage_adequate"))).alias("test_coverage_adequate"),
        F.expr(J.f_int(_fv('vetoed_count'))).alias("vetoed_count"),
        F.expr(f"{_fv('summary')}.s").alias("summary"),
        F.expr(f"CASE WHEN {m}.t = 'VOID' THEN NULL ELSE {J.f_float(m)} END").alias("mean_confidence_score"),
        F.expr(f"CAST({findings} AS {FINDINGS_TYPE})").alias("findings"))
    return x.select(*[c for c in df.columns], F.inline(F.array(out)))


#: what a failed call's message shows of its kind, first match first; anything else is ``other``
ERROR_KINDS = [
    ("http", r"(?i)\bHTTP\b[ /0-9.]*[ :][1-5][0-9][0-9]|ClientResponseError"),
    ("timeout", r"(?i)time(?:d[ -]?|[ -]?)out|deadline exceeded"),
    ("validation", r"ValueError|ValidationError|JSONDecodeError"),
    ("connection", r"(?i)connect|reset by peer|refused|unreachable|name resolution|\b(?:DNS|SSL|TLS)\b"),
]


def error_kind(message: Column) -> Column:
    """The kind that a failed call's message shows (a log with kinds of its own needs no guess)."""
    kind = F.lit("other")
    for name, pattern in reversed(ERROR_KINDS):
        kind = F.when(message.rlike(pattern), F.lit(name)).otherwise(kind)
    return kind


def classify_errors(df: DataFrame, error_type: str = "error_type", message: str = "error") -> DataFrame:
    """retryable = timeout / validation error, whatever its message, or an HTTP 429/5xx code
    anywhere in the message."""
    codes = "|".join(P.RETRYABLE_HTTP_CODES)
    retry = (F.coalesce(F.lower(F.col(error_type)).isin(*P.RETRYABLE_ERROR_TYPES), F.lit(False))
             | F.coalesce(F.col(message).rlike(codes), F.lit(False)))
    return df.withColumn("retryable", retry)


#: columns of a validated attempt that only validation needs; shed them before the log is shuffled
ATTEMPT_TEXTS = ("raw_text", "cleaned", "payload", "parse_error", "error", "error_type")


def classify_attempts(validated: DataFrame) -> DataFrame:
    """D9 on validated attempts: ``error_type`` and ``retryable`` of those that are not valid. A
    failed call (``error`` is set, though it may be empty, as a timeout's often is) has the kind that
    landed in the log's ``error_type``, else the one its message shows; a text that fails its contract
    is a ``validation`` error."""
    landed = F.lower(F.col("error_type")) if "error_type" in validated.columns else F.lit(None).cast("string")
    kind = (F.when(F.col("valid"), F.lit(None)).when(F.col("error").isNotNull(), F.coalesce(landed, error_kind(F.col("error"))))
            .otherwise(F.lit("validation")))
    return classify_errors(validated.withColumn("error_type", kind), "error_type", "error").withColumn(
        "retryable", F.col("valid") | F.col("retryable"))


def _fold_sql(attempts: str, fallback_enabled: bool) -> str:
    """SQL: one pass over a key's attempts in order. The state says whether the primary run has
    ended, whether the fallback was tried, which attempt won, and what the made ones took."""
    key = "(x.prank * 1000000 + x.attempt)"
    go = (f"coalesce(s.won < 0 AND {key} <> s.at AND CASE WHEN x.prank = 0 THEN NOT s.ended "
          f"ELSE {str(bool(fallback_enabled)).lower()} AND NOT s.fell_over END, false)")
    return f"""aggregate({attempts},
  named_struct('won', -1, 'ended', false, 'fell_over', false, 'made', 0, 'elapsed', 0.0D, 'last', CAST(NULL AS STRING), 'at', -1, 'i', 0),
  (s, x) -> named_struct('won', CASE WHEN {go} AND x.valid THEN s.i ELSE s.won END,
    'ended', s.ended OR ({go} AND x.prank = 0 AND NOT x.valid AND NOT x.retryable),
    'fell_over', s.fell_over OR ({go} AND x.prank = 1),
    'made', s.made + CASE WHEN {go} THEN 1 ELSE 0 END,
    'elapsed', s.elapsed + CASE WHEN {go} THEN coalesce(x.latency_s, 0.0D) ELSE 0.0D END,
    'last', CASE WHEN {go} AND NOT x.valid THEN x.reason ELSE s.last END, 'at', {key}, 'i', s.i + 1))"""


def resolve_attempts(log: DataFrame, max_retries: int = P.MAX_RETRIES, fallback_enabled: bool = True,
                     sla_seconds: float = P.SUBAGENT_TIMEOUT_SECONDS) -> DataFrame:
    """D10 + D11 + D13: per (pr_id, agent), the attempt whose report is used.

    Primary attempts run in order, at most ``max_retries``; the first valid one wins; an
    error that is not retryable ends the primary run. Then, when a fallback provider is
    configured, exactly one fallback attempt. ``elapsed_s`` sums the latency of the
    attempts actually made; past ``sla_seconds`` the agent times out whatever the
    outcome. An attempt that landed repeatedly counts once (its quickest copy). Needs
    ``pr_id, agent, attempt, provider, latency_s, valid, reason`` and optionally
    ``retryable`` (missing -> every failure retryable, as validation errors are).
    Output: ``pr_id, agent, outcome ('ok'|'timeout'|'failed'), attempt_used,
    attempts_made, elapsed_s, last_error`` plus the chosen row's report columns.

    A key's attempts (no more than the retry budget and the fallback's, equal copies merged before
    the shuffle) meet in one array, in order, and one fold over it decides.
    """
    if "retryable" not in log.columns:
        log = log.withColumn("retryable", F.lit(True))
    prank = F.when(F.col("provider") == "primary", 0).otherwise(1)
    # Primary attempts past the retry budget are never made: drop them before the shuffle.
    x = log.withColumn("prank", prank).filter((F.col("prank") == 1) | (F.col("attempt") <= max_retries))
    lead = ["prank", "attempt", "latency_s", "reason", "valid", "retryable"]
    report_cols = [c for c in log.columns if c not in ("pr_id", "agent", "retryable")]
    attempt = F.struct(*lead, *[c for c in report_cols if c not in lead])
    g = (x.groupBy("pr_id", "agent").agg(F.array_sort(F.collect_set(attempt)).alias("attempts"))
         .select("pr_id", "agent", "attempts", F.expr(_fold_sql("attempts", fallback_enabled)).alias("f"))
         .select("pr_id", "agent", "f", F.expr("CASE WHEN f.won >= 0 THEN attempts[f.won] END").alias("chosen")))
    outcome = (F.when(F.col("f.elapsed") > sla_seconds, F.lit("timeout"))
               .when(F.col("chosen").isNotNull(), F.lit("ok")).otherwise(F.lit("failed")))
    return g.select("pr_id", "agent", outcome.alias("outcome"),
                    F.col("chosen.attempt").alias("attempt_used"), F.col("f.made").alias("attempts_made"),
                    F.col("f.elapsed").alias("elapsed_s"), F.col("f.last").alias("last_error"),
                    *[F.col(f"chosen.{c}").alias(c) for c in report_cols if c != "attempt"])


def sla_outcome(resolved: DataFrame) -> DataFrame:
    """Agents past the limit become ``{error: 'Timeout', status: 'fail'}``; other
    failures keep their message."""
    err = (F.when(F.col("outcome") == "timeout", F.lit("Timeout"))
           .when(F.col("outcome") == "failed", F.coalesce(F.col("last_error"), F.lit("no output"))))
    return resolved.withColumn("error", err)


def _na_finding(desc):
    return F.array(F.struct(desc.alias("description"), F.lit("N/A").alias("file_reference"),
                            F.lit(0).alias("line_number"), F.lit(1.0).alias("confidence_score")))


def with_defaults(resolved: DataFrame, scans: DataFrame | None = None, prs: DataFrame | None = None) -> DataFrame:
    """D12 + D13: final per-(pr, agent) result row.

    ok -> the validated report; timeout -> status fail, error 'Timeout', no report
    fields; failed -> the agent's fixed fallback (security fail / high when the scan
    found something else unknown; architecture fail, 1; testing warn, false; critic
    fail, no findings, 0). Expects typed report columns.
    """
    if prs is not None:
        # Every PR gets every agent: a generated (pr, agent) grid, left-joined to what
        # was resolved; a PR with no landed output fails like an agent that raised.
        grid = prs.select("pr_id").distinct().withColumn("agent", F.explode(F.array(*[F.lit(a) for a in P.ALL_AGENTS])))
        resolved = grid.join(resolved, ["pr_id", "agent"], "left").withColumn(
            "outcome", F.coalesce(F.col("outcome"), F.lit("failed"))).withColumn(
            "attempts_made", F.coalesce(F.col("attempts_made"), F.lit(0))).withColumn(
            "elapsed_s", F.coalesce(F.col("elapsed_s"), F.lit(0.0))).withColumn(
            "last_error", F.coalesce(F.col("last_error"), F.lit("no output")))
    x = sla_outcome(resolved)
    if scans is not None:
        x = x.join(scans.select("pr_id", F.col("scan_summary")), "pr_id", "left")
    else:
        x = x.withColumn("scan_summary", F.lit(""))
    has_scan = F.coalesce(F.col("scan_summary"), F.lit("")) != ""
    ag, oc = F.col("agent"), F.col("outcome")
    failed = oc == "failed"
    e = F.col("error")
    sec_desc = F.when(has_scan, F.concat(F.lit(P.SECURITY_SCAN_FALLBACK),
                                         F.col("scan_summary"))).otherwise(F.concat(F.lit(P.SECURITY_FALLBACK), e))
    default_findings = (F.when(ag == "security", _na_finding(sec_desc))
                        .when(ag == "architecture", _na_finding(F.concat(F.lit(P.ARCHITECTURE_FALLBACK), e)))
                        .when(ag == "testing", _na_finding(F.concat(F.lit(P.TESTING_FALLBACK), e)))
                        .otherwise(F.array().cast(FINDINGS_TYPE)))
    default_status = F.when(ag == "testing", F.lit("warn")).otherwise(F.lit("fail"))
    return x.select(
        "pr_id", "agent", "outcome", "error", "elapsed_s", "attempts_made",
        F.when(oc == "timeout", F.lit("fail")).when(failed, default_status).otherwise(F.col("status")).alias("status"),
        F.when(failed & (ag == "security"), F.when(has_scan, F.lit("high")).otherwise(F.lit("unknown")))
        .when(oc == "ok", F.col("severity_level")).alias("severity_level"),
        F.when(failed & (ag == "architecture"), F.lit(1)).when(oc == "ok", F.col("complexity_score"))
        .alias("complexity_score"),
        F.when(failed & (ag == "testing"), F.lit(False)).when(oc == "ok", F.col("test_coverage_adequate"))
        .alias("test_coverage_adequate"),
        F.when(failed & (ag == "critic"), F.lit(0)).when(oc == "ok", F.col("vetoed_count")).alias("vetoed_count"),
        F.when(failed & (ag == "critic"), F.concat(F.lit(P.CRITIC_FALLBACK), e))
        .when(oc == "ok", F.col("summary")).alias("summary"),
        F.when(failed, default_findings).when(oc == "ok", F.col("findings"))
        .otherwise(F.lit(None).cast(FINDINGS_TYPE)).alias("findings"))


def explode_findings(results: DataFrame) -> DataFrame:
    """Long table ``pr_id, agent, ord, description, file_reference, line_number,
    confidence_score`` (generator, no shuffle)."""
    x = results.select("pr_id", "agent", F.posexplode("findings").alias("ord", "f"))
    return x.select("pr_id", "agent", F.col("ord").cast("int"), F.col("f.description").alias("description"),
                    F.col("f.file_reference").alias("file_reference"), F.col("f.line_number").alias("line_number"),
                    F.col("f.confidence_score").alias("confidence_score"))


def wrap_payload(c) -> Column:
    return F.concat(F.lit(P.PAYLOAD_OPEN + "\n"), c, F.lit("\n" + P.PAYLOAD_CLOSE))


def agent_json(agent: str) -> Column:
    """One agent's result as the service shapes it: its contract fields (or the fallback with the
    same fields), or ``{error, status, agent}`` after a timeout."""
    f = F.col("findings")
    shapes = {
        "security": [F.col("status"), F.col("severity_level"), f.alias("findings_summary")],
        "architecture": [F.col("status"), F.col("complexity_score"), f.alias("refactor_suggestions")],
        "testing": [F.col("status"), F.col("test_coverage_adequate"), f.alias("qa_notes")],
        "critic": [F.col("status"), f.alias("approved_findings"), F.col("vetoed_count"), F.col("summary")],
    }
    timeout = F.to_json(F.struct(F.col("error"), F.col("status"), F.col("agent")))
    return F.when(F.col("outcome") == "timeout", timeout).otherwise(F.to_json(F.struct(*shapes[agent])))


def json_object(members: dict[str, Column]) -> Column:
    """A JSON object of members that are JSON texts already (NULL: ``{}``)."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[
        F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("{}"))) for name, value in members.items()]), F.lit("}"))


def as_findings(items: Column, kind: str) -> Column:
    """Findings of any shape as an array of finding structs.

    ``kind='string'``: plain texts, each a description without place or confidence.
    ``kind='variant'``: objects by their fields (a confidence that is no number is 0, a missing one
    NULL), texts as descriptions, anything else by its JSON text."""
    if kind == "string":
        return F.transform(items, lambda t: F.struct(
            t.alias("description"), F.lit(None).cast("string").alias("file_reference"),
            F.lit(None).cast("bigint").alias("line_number"), F.lit(None).cast("double").alias("confidence_score")))
    if kind != "variant":
        raise ValueError(f"unknown kind {kind!r}")
    get = lambda v, path, t: F.try_variant_get(v, path, t)
    is_obj = lambda v: F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))
    return F.transform(items, lambda v: F.when(is_obj(v), F.struct(
        F.coalesce(get(v, "$.description", "string"), F.lit("")).alias("description"),
        get(v, "$.file_reference", "string").alias("file_reference"), get(v, "$.line_number", "bigint").alias("line_number"),
        F.when(get(v, "$.confidence_score", "variant").isNotNull(),
               F.coalesce(get(v, "$.confidence_score", "double"), F.lit(0.0))).alias("confidence_score")))
        .otherwise(F.struct(get(v, "$", "string").alias("description"), F.lit(None).cast("string").alias("file_reference"),
                            F.lit(None).cast("bigint").alias("line_number"), F.lit(None).cast("double").alias("confidence_score"))))


def build_requests(prs: DataFrame, prompts: DataFrame, scans: DataFrame | None = None,
                   reports: DataFrame | None = None, diff_col: str = "sanitized_diff") -> DataFrame:
    """One chat request per (PR, agent): ``pr_id, agent, system, user, breakout``.

    The three reviewers get the masked diff inside the untrusted-payload tags; security
    also gets the scan summary; the critic gets the three reports as one JSON object, each
    with its agent's own fields (``{}`` where none landed), and the diff when non-empty.
    ``breakout`` flags a diff that contains the closing tag.
    """
    # one row per known agent, whatever the table holds: that bounds the broadcast
    pt = F.broadcast(prompts.filter(F.col("agent").isin(*P.ALL_AGENTS)).dropDuplicates(["agent"]))
    base = prs.select("pr_id", F.coalesce(F.col(diff_col), F.lit("")).alias("d"))
    if scans is not None:
        base = base.join(scans.select("pr_id", "scan_summary"), "pr_id", "left")
    else:
        base = base.withColumn("scan_summary", F.lit(""))
    if reports is not None:
        rep = reports.groupBy("pr_id").agg(*[
            F.first(F.when(F.col("agent") == a, agent_json(a)), ignorenulls=True).alias(f"__{a}") for a in P.REVIEW_AGENTS])
        rep = rep.select("pr_id", json_object({f"{a}_agent_output": F.col(f"__{a}") for a in P.REVIEW_AGENTS}).alias("reports_json"))
        base = base.join(rep, "pr_id", "left")
    else:
        base = base.withColumn("reports_json", F.lit(None).cast("string"))
    agents = base.withColumn("agent", F.explode(F.array(*[F.lit(a) for a in P.ALL_AGENTS])))
    scan = F.coalesce(F.col("scan_summary"), F.lit(""))
    user = (F.when(F.col("agent") == "critic", F.concat(
                F.lit(P.CRITIC_INTRO), F.coalesce(F.col("reports_json"), json_object(
                    {f"{a}_agent_output": F.lit("{}") for a in P.REVIEW_AGENTS})),
                F.when(F.col("d") != "", F.concat(F.lit(P.CRITIC_DIFF_INTRO), wrap_payload(F.col("d")))).otherwise(F.lit(""))))
            .when((F.col("agent") == "security") & (scan != ""), F.concat(wrap_payload(F.col("d")), F.lit(P.SCAN_PREAMBLE), scan))
            .otherwise(wrap_payload(F.col("d"))))
    j = agents.join(pt, "agent", "left")
    return j.select("pr_id", "agent", F.coalesce(F.col("system"), F.lit("")).alias("system"), user.alias("user"),
                    F.col("d").contains(P.PAYLOAD_CLOSE).alias("breakout"))


def final_results(resolved: DataFrame, scans: DataFrame, prs: DataFrame,
                  diff_col: str = "sanitized_diff") -> DataFrame:
    """D12 + B5: per-(PR, agent) results for every PR, with the large-PR rule applied to
    architecture results that did not time out (it follows the fallback, not a timeout).
    ``prs`` carries the masked, capped diff whose lines are counted."""
    from .diffs import apply_large_pr_rule
    r = with_defaults(resolved, scans, prs)
    applies = (F.col("agent") == "architecture") & (F.col("outcome") != "timeout")
    return apply_large_pr_rule(r, prs, diff_col, applies=applies).withColumnRenamed("is_large", "large_pr")
