import json
import re
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from reviewlake.functions import jsonx as J
from reviewlake.operators import contracts as C

F1 = '{"description":"d","file_reference":"a.py","line_number":3,"confidence_score":0.5}'


@pytest.mark.parametrize("text,expected", [
    ("```json\n{\"a\":1}\n```", '{"a":1}'),
    ("pre ```JSON {\"a\":1}``` post ```x```", '{"a":1}'),
    ("```\n[1]\n```", "[1]"),
    ("  {\"a\":1}\n", '{"a":1}'),
])
def test_strip_fence(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert rows(df.select(F.expr(J.strip_fence_sql("t"))))[0][0] == expected


@pytest.mark.parametrize("text,ok", [('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}, 2', False),
                                     ("1], [2", False), ("", False), ("null", True), ("{'a':1}", False)])
def test_strict_json(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert rows(df.select(F.expr(f"({J.strict_parse_sql('t')}) IS NOT NULL")))[0][0] is ok


def validate(spark, agent, text):
    df = spark.createDataFrame([(1, agent, 1, "primary", 1.0, text)],
                               "pr_id long, agent string, attempt int, provider string, latency_s double, raw_text string")
    return rows(C.validate_reports(C.parse_reports(df)), "valid", "reason")[0]


@pytest.mark.parametrize("agent,text,ok", [
    ("security", '{"status":"pass","severity_level":"low"}', True),                # missing list -> []
    ("security", '{"status":"pass","severity_level":"low","findings_summary":null}', False),
    ("security", '{"status":"warn","severity_level":"low"}', False),              # out of enum
    ("security", '{"status":"pass","severity_level":"LOW"}', False),              # enums are exact
    ("architecture", '{"status":"pass","complexity_score":3.7}', False),          # 3.7 is not an int
    ("architecture", '{"status":"pass","complexity_score":"3"}', True),           # "3" is
    ("architecture", '{"status":"pass","complexity_score":11}', False),
    ("testing", '{"status":"warn","test_coverage_adequate":"yes"}', True),
    ("testing", '{"status":"warn","test_coverage_adequate":"maybe"}', False),
    ("testing", f'{{"status":"pass","test_coverage_adequate":true,"qa_notes":[{F1}]}}', True),
    ("testing", '{"status":"pass","test_coverage_adequate":true,"qa_notes":[{"description":"d","file_reference":"",'
                '"line_number":-1,"confidence_score":0.5}]}', False),
    ("testing", '{"status":"pass","test_coverage_adequate":true,"qa_notes":["plain"]}', False),
    ("critic", '{"overall_status":"fail","vetoed_count":0,"summary":"s","mean_confidence_score":null}', True),
    ("critic", '{"overall_status":"fail","vetoed_count":0,"summary":"s","mean_confidence_score":1.5}', False),
    ("critic", '{"overall_status":"fail","vetoed_count":0,"summary":3}', False),
    ("critic", '[1]', False),
    ("security", '{"status":"fail","status":"pass","severity_level":"low"}', True),  # last duplicate wins
])
def test_contracts(spark, agent, text, ok):
    valid, reason = validate(spark, agent, text)
    assert valid is ok, reason


def test_reason_names_first_failing_field(spark):
    assert validate(spark, "security", '{"status":"x","severity_level":"y"}')[1] == \
        "LLM output failed validation (security): field status"
    assert validate(spark, "security", "nope")[1].startswith("LLM returned non-JSON content\n---\nnope")


def log(spark, rows_):
    df = spark.createDataFrame(rows_, "pr_id long, agent string, attempt int, provider string, latency_s double, "
                                      "valid boolean, retryable boolean, reason string")
    return df.withColumn("status", F.lit("pass"))


def test_resolve_first_valid_primary_and_failover(spark):
    r = log(spark, [
        (1, "testing", 1, "primary", 5.0, False, True, "bad"), (1, "testing", 2, "primary", 5.0, True, True, None),
        (1, "testing", 3, "fallback", 5.0, True, True, None),
        (2, "testing", 1, "primary", 1.0, False, True, "e1"), (2, "testing", 2, "primary", 1.0, False, True, "e2"),
        (2, "testing", 3, "fallback", 1.0, True, True, None),
        (3, "testing", 1, "primary", 1.0, False, False, "401 auth"), (3, "testing", 2, "primary", 1.0, True, True, None),
        (3, "testing", 3, "fallback", 1.0, False, True, "e3"),
        (4, "testing", 1, "primary", 30.0, False, True, "e"), (4, "testing", 2, "primary", 30.0, True, True, None),
    ])
    got = {a: (b, c, d, e) for a, b, c, d, e in rows(C.resolve_attempts(r), "pr_id", "outcome", "attempt_used",
                                                     "attempts_made", "elapsed_s")}
    assert got[1] == ("ok", 2, 2, 10.0)
    assert got[2] == ("ok", 3, 3, 3.0)
    assert got[3] == ("failed", None, 2, 2.0)   # non-retryable ends the primary run, fallback fails
    assert got[4] == ("timeout", 2, 2, 60.0)    # past the 40 s limit whatever the outcome
    nofb = {a: b for a, b in rows(C.resolve_attempts(r, fallback_enabled=False), "pr_id", "outcome")}
    assert nofb[2] == "failed"


def test_classify_errors(spark):
    df = spark.createDataFrame([("timeout", None), ("http", "HTTP 503 from upstream"), ("http", "HTTP 401"),
                                ("Validation", "x")], "error_type string, error string")
    assert [r[0] for r in C.classify_errors(df).select("retryable").collect()] == [True, True, False, True]


def test_build_requests_shapes(spark):
    from reviewlake.functions import patterns as P
    prs = spark.createDataFrame([(1, "diff text"), (2, "")], "pr_id long, sanitized_diff string")
    prompts = spark.createDataFrame([(a, f"sys {a}") for a in P.ALL_AGENTS], "agent string, system string")
    scans = spark.createDataFrame([(1, "=== Gitleaks findings ===\nHIGH r a.py:1"), (2, "")], "pr_id long, scan_summary string")
    rep = spark.createDataFrame([(1, "security", "ok", "fail", "high", None, None, None, None)],
                                f"pr_id long, agent string, outcome string, status string, severity_level string, complexity_score int, "
                                f"test_coverage_adequate boolean, findings {C.FINDINGS_TYPE}, error string")
    r = {(a, b): (c, d, e) for a, b, c, d, e in rows(C.build_requests(prs, prompts, scans, rep),
                                                     "pr_id", "agent", "system", "user", "breakout")}
    assert r[(1, "testing")] == ("sys testing", "<UNTRUSTED_PAYLOAD>\ndiff text\n</UNTRUSTED_PAYLOAD>", False)
    assert r[(1, "security")][1].startswith("<UNTRUSTED_PAYLOAD>\ndiff text\n</UNTRUSTED_PAYLOAD>\n\n---\n")
    assert r[(1, "security")][1].endswith("HIGH r a.py:1")
    assert r[(2, "security")][1] == "<UNTRUSTED_PAYLOAD>\n\n</UNTRUSTED_PAYLOAD>"
    critic = r[(1, "critic")][1]
    assert critic.startswith(P.CRITIC_INTRO) and critic.endswith("\n\n<UNTRUSTED_PAYLOAD>\ndiff text\n</UNTRUSTED_PAYLOAD>")
    sent = json.loads(critic[len(P.CRITIC_INTRO):critic.index("\n\n---\n")])
    assert sent == {"security_agent_output": {"status": "fail", "severity_level": "high"},
                    "architecture_agent_output": {}, "testing_agent_output": {}}
    assert "<UNTRUSTED_PAYLOAD>" not in r[(2, "critic")][1]  # no diff, no payload block


def test_final_results_large_pr_skips_timeouts(spark):
    from reviewlake.functions import patterns as P
    big = "+x\n" * (P.LARGE_PR_THRESHOLD + 1)
    prs = spark.createDataFrame([(1, big), (2, big), (3, big)], "pr_id long, sanitized_diff string")
    res = spark.createDataFrame([
        (1, "architecture", "ok", 1, 1, 5.0, None, True, "pass", 3, []),
        (2, "architecture", "timeout", 1, 2, 60.0, "e", True, "pass", 3, []),
    ], f"pr_id long, agent string, outcome string, attempt_used int, attempts_made int, elapsed_s double, "
       f"last_error string, valid boolean, status string, complexity_score int, findings {C.FINDINGS_TYPE}")
    for c, t in [("severity_level", "string"), ("test_coverage_adequate", "boolean"), ("vetoed_count", "int"),
                 ("summary", "string")]:
        res = res.withColumn(c, F.lit(None).cast(t))
    scans = spark.createDataFrame([(1, ""), (2, ""), (3, "")], "pr_id long, scan_summary string")
    out = C.final_results(res, scans, prs).filter("agent = 'architecture'")
    got = {a: (b, c, d) for a, b, c, d in rows(out, "pr_id", "outcome", "status", F.size("findings"))}
    assert got[1] == ("ok", "warn", 1)          # pass -> warn + High Risk note
    assert got[2] == ("timeout", "fail", None)  # a timeout carries no report and no note
    assert got[3] == ("failed", "fail", 2)      # no output: fallback finding + note


def test_huge_numbers_reject_a_report_and_leave_its_neighbours(spark):
    finding = '{"description":"d","file_reference":"f","line_number":%s,"confidence_score":0.5}'
    arch = '{"status":"pass","complexity_score":%s,"refactor_suggestions":[%s]}'
    texts = [arch % (3, finding % 3000000000), arch % (3, finding % "1e300"), arch % (3, finding % ("9" * 20)),
             arch % (3, finding % ('"' + "9" * 30 + '"')), arch % (3000000000, ""), arch % ("1e300", ""), arch % (4, finding % 7)]
    df = spark.createDataFrame([(i, "architecture", t) for i, t in enumerate(texts)], "pr_id long, agent string, raw_text string")
    got = {r["pr_id"]: r for r in C.validate_reports(C.parse_reports(df)).collect()}
    assert [got[i]["valid"] for i in range(7)] == [True, False, False, False, False, False, True]
    assert got[0]["findings"][0]["line_number"] == 3000000000 and got[6]["complexity_score"] == 4


def test_findings_of_any_shape(spark):
    df = spark.createDataFrame([(["plain text"],)], "f array<string>")
    (found,) = df.select(C.as_findings(F.col("f"), "string")).first()
    assert [tuple(x) for x in found] == [("plain text", None, None, None)]
    raw = '[{"description":"a","confidence_score":"high"},{"description":"b","file_reference":"x.py","line_number":4},"c",5]'
    df = spark.createDataFrame([(raw,)], "t string").select(F.expr("cast(parse_json(t) AS array<variant>)").alias("f"))
    (found,) = df.select(C.as_findings(F.col("f"), "variant")).first()
    assert [tuple(x) for x in found] == [("a", None, None, 0.0), ("b", "x.py", 4, None), ("c", None, None, None),
                                         ("5", None, None, None)]


KINDS = [("timeout", "", True), ("TIMEOUT", "x", True), ("validation", "y", True), ("http", "HTTP 401 Unauthorized", False),
         ("http", "HTTP 503 Service Unavailable", True), ("connection", "reset", False), ("other", "code 429 seen", True),
         (None, "ReadTimeout: timed out", True), (None, "TimeoutError", True), (None, "asyncio deadline exceeded", True),
         (None, "ValueError: no choices", True), (None, "HTTP 408 Request Timeout", False), (None, "HTTP/1.1 504 Gateway Timeout", True),
         (None, "Cannot connect to host", False), (None, "KeyError: 'choices'", False), (None, "", False)]


def test_every_kind_of_failed_call(spark):
    rows = [(i, False, message, kind) for i, (kind, message, _) in enumerate(KINDS)] + [(99, False, None, None), (100, True, None, None)]
    df = spark.createDataFrame(rows, "i int, valid boolean, error string, error_type string")
    got = {r.i: (r.error_type, r.retryable) for r in C.classify_attempts(df).collect()}
    assert {i: got[i][1] for i in range(len(KINDS))} == {i: retry for i, (*_, retry) in enumerate(KINDS)}
    assert [got[i][0] for i in range(7, 16)] == ["timeout", "timeout", "timeout", "validation", "http", "http", "connection", "other", "other"]
    assert got[99] == ("validation", True) and got[100] == (None, True)
    bare = C.classify_attempts(df.drop("error_type")).collect()  # a log without kinds
    assert {r.i: r.retryable for r in bare}[0] is False and {r.i: r.retryable for r in bare}[8] is True


def played(attempts, max_retries, fallback):
    """The attempts as the service makes them, one after another."""
    made, elapsed, last = 0, 0.0, None
    seen = {}
    for a in attempts:  # (attempt, provider, latency, valid, retryable, reason): of copies the quickest
        k = (a[1] != "primary", a[0])
        seen[k] = min(seen.get(k, a), a, key=lambda x: (x[2], x[5] is not None, x[5] or "", x[3], x[4]))
    primary = [seen[k] for k in sorted(seen) if not k[0] and k[1] <= max_retries]
    for run in (primary, [seen[k] for k in sorted(seen) if k[0]][:1] if fallback else []):
        for a in run:
            made, elapsed = made + 1, elapsed + a[2]
            if a[3]:
                return "ok" if elapsed <= 40 else "timeout", a[0], made, elapsed, last
            last = a[5]
            if not a[4]:
                break
    return "timeout" if elapsed > 40 else "failed", None, made, elapsed, last


def test_resolution_plays_the_attempts_in_order(spark):
    import random
    rnd = random.Random(8)
    log, want = [], {}
    for pr in range(400):
        own = []
        for provider in ("primary", "fallback"):
            for attempt in range(1, rnd.randint(0, 4) + 1):
                for _ in range(rnd.choice([1, 1, 1, 3])):
                    valid = rnd.random() < 0.3
                    own.append((attempt, provider, float(rnd.randint(0, 18)), valid, valid or rnd.random() < 0.6, None if valid else rnd.choice(["", "a", "b"])))
        rnd.shuffle(own)
        log += [(pr, "security", *a) for a in own]
        want[pr] = own
    df = spark.createDataFrame(log, "pr_id int, agent string, attempt int, provider string, latency_s double, valid boolean, retryable boolean, reason string")
    for retries, fallback in ((2, True), (2, False), (3, True), (1, True)):
        got = {r.pr_id: (r.outcome, r.attempt_used, r.attempts_made, r.elapsed_s, r.last_error)
               for r in C.resolve_attempts(df.repartition(7), retries, fallback).collect()}
        for pr, own in want.items():
            if pr in got:
                o, used, *rest = played(own, retries, fallback)
                assert (got[pr][0], *got[pr][2:]) == (o, *rest), (pr, own)
                assert o != "ok" or got[pr][1] == used


def test_json_is_what_pythons_parser_takes(spark):
    import json
    texts = ['{"a":NaN}', "NaN", "-Infinity", "[Infinity, -Infinity ,NaN]", '{"a":"NaN"}', '{"NaN":"x Infinity \\" NaN"}', '["\\\\",NaN]',
             "xNaN", "NaNx", "+NaN", "-NaN", "1NaN", "NaN NaN", '"a"NaN', "{NaN:1}", '{"a":nan}', "[1,2", "1,2", "1]", '1],"x', '[1] [2]', "", " ",
             "null", "true", '"x"', "{}", "[]", '{"a":1}}', '{"a":1},', '{"a":1}{"b":2}', "\n{\"a\": [1, {\"b\": NaN}]}\t", "'a'", "Infinity5",
             '{"a":"' + "\\n" * 20000 + '","b":NaN}', '["' + "x" * 50000 + '",Infinity]', "[1.5e3,-0]", '{"a":1,"a":2}']

    def ok(t):
        try:
            json.loads(t)
            return True
        except ValueError:
            return False
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw_text string")
    got = {r.i: r.ok for r in C.parse_reports(df).selectExpr("i", "payload IS NOT NULL AS ok").collect()}
    assert {texts[i][:40]: v for i, v in got.items()} == {t[:40]: ok(t) for t in texts}
    kept = spark.createDataFrame([('{"s":"NaN, Infinity","n":NaN}',)], "raw_text string")
    row = C.parse_reports(kept).selectExpr("try_variant_get(payload, '$.s', 'string') AS s", "try_variant_get(payload, '$.n', 'double') AS n").first()
    assert row.s == "NaN, Infinity" and not 0 <= row.n <= 1


FENCED = ["``` ```", "``````", "`````", "````json a````", "```json```", "```jsonjson x```", "```JsOn\x0b\f {} \r\n``` ```b```", "``` x ```",
          "a ```json\n{\"x\": \"``\"}\n```", "```json\n{}", "``` a ``b`` ```", "  plain  \n", "", "```  ```", "```json json```", "x```a```json```b```",
          "``` false ```", "```json\nfff\n```", "```\t[1]\t`````", "````` x ```", "```js\non```"]


def test_fence_equals_its_pattern(spark):
    def plain(t):
        hit = re.search(J.FENCE, t, re.A)
        return hit.group(1) if hit else t.strip()
    df = spark.createDataFrame([(t,) for t in FENCED], "t string")
    assert rows(df.select("t", F.expr(J.strip_fence_sql("t")))) == [(t, plain(t)) for t in FENCED]
    assert rows(spark.sql("SELECT CAST(NULL AS STRING) AS t").select(F.expr(J.strip_fence_sql("t")))) == [(None,)]


def test_fence_of_many_blanks_takes_no_square_time(spark):
    text = "```json\nx" + " " * 400_000 + "y```"
    df = spark.createDataFrame([(text,)], "t string")
    begin = time.monotonic()
    assert rows(df.select(F.expr(J.strip_fence_sql("t"))))[0][0] == text[8:-3]
    assert time.monotonic() - begin < 20


def test_findings_of_odd_shapes(spark):
    def report(items):
        df = spark.createDataFrame([(1, "testing", '{"status":"pass","test_coverage_adequate":true,"qa_notes":%s}' % items)], "pr_id long, agent string, raw_text string")
        return rows(C.validate_reports(C.parse_reports(df)), "valid", "findings")[0]
    assert [report(x)[0] for x in ("[{}]", "[null]", "[[1]]", "[7]", f"[{F1},null]", "{}")] == [False] * 6
    for x in ('{"description":null,"file_reference":"a","line_number":0,"confidence_score":0}', '{"description":"d","file_reference":["a"],"line_number":0,"confidence_score":0}'):
        assert report(f"[{x}]")[0] is False
    ok, found = report('[{"confidence_score":true,"line_number":"7","more":{"description":1},"file_reference":"","description":"d"}]')
    assert ok and [tuple(f) for f in found] == [("d", "", 7, 1.0)]
