from pyspark.sql import functions as F

from conftest import rows
from reviewlake.operators import report as G
from reviewlake.operators import verdict as V
from reviewlake.operators.contracts import FINDINGS_TYPE

FIND = "struct<description:string,file_reference:string,line_number:int,confidence_score:double>"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_badge(spark):
    df = spark.createDataFrame([("pass",), ("WARN",), ("Fail",), ("maybe",)], "s string")
    assert [r[0] for r in df.select(G.badge(F.col("s"))).collect()] == ["✅ Pass", "⚠️ Warn", "❌ Fail", "❓ maybe"]


def test_format_finding_parts(spark):
    df = spark.createDataFrame([("d", "a.py", 3, 0.5), ("d", "", 3, 0.125), ("d", "b.py", 0, None)],
                               "description string, file_reference string, line_number int, confidence_score double")
    got = [r[0] for r in df.select(G.format_finding(F.struct("*"))).collect()]
    assert got == ["d — `a.py` line 3 — confidence: 50%", "d — confidence: 12%", "d — `b.py`"]


def test_bullet_list_none(spark):
    assert one(spark, G.bullet_list(F.array().cast(f"array<{FIND}>"))) == "_None_\n"


def test_worst_status_ties_and_unknown(spark):
    res = spark.createDataFrame([(1, "security", "WARN"), (1, "architecture", "warn"), (1, "testing", "pass"),
                                 (2, "security", "pass"), (2, "testing", "maybe"),
                                 (3, "security", "pass"), (3, "architecture", "pass"), (3, "testing", "pass")],
                                "pr_id long, agent string, status string")
    got = dict(rows(V.worst_status(res), "pr_id", "worst_status"))
    assert got == {1: "WARN", 2: "fail", 3: "pass"}  # missing architecture counts as fail and wins the tie


def test_append_metrics_once(spark):
    df = spark.createDataFrame([("report\n\n", 2.5, 0.5), ("has Governance Metrics", 1.0, None), ("", 1.0, None)],
                               "md string, lat double, m double")
    got = [r[0] for r in df.select(G.append_metrics(F.col("md"), F.col("lat"), F.col("m"))).collect()]
    assert got[0] == ("report\n\n---\n\n### 📊 Governance Metrics\n\n| Metric | Value |\n|---|---|\n"
                      "| **Pipeline Latency** | `2.50s` |\n| **Estimated LLM Cost** | `$0.0010` |\n"
                      "| **Mean Confidence Score** | `50%` |\n")
    assert got[1] == "has Governance Metrics" and got[2] == ""


def test_fallback_report_sections(spark):
    res = spark.createDataFrame([
        (7, "security", "warn", "medium", None, None, []),
        (7, "architecture", "pass", None, 3, None, []),
        (7, "testing", "fail", None, None, False, [("note", "", 0, None)]),
    ], f"pr_id long, agent string, status string, severity_level string, complexity_score int, "
       f"test_coverage_adequate boolean, findings array<{FIND}>")
    piv = res.groupBy("pr_id").agg(*[F.first(F.when(F.col("agent") == a, F.struct(
        "status", "severity_level", "complexity_score", "test_coverage_adequate", "findings")), ignorenulls=True).alias(a)
        for a in ["security", "architecture", "testing"]])
    md = piv.select(G.agent_report(F.col("pr_id"), F.col("security"), F.col("architecture"), F.col("testing"),
                                   "2024-01-01 00:00 UTC")).first()[0]
    assert md.startswith("## 🤖 Automated Code Review — PR #7\n\n> **Overall result: ❌ Fail**")
    assert "| **Severity Level** | `medium` |" in md and "| **Complexity Score** | `3 / 10` |" in md
    assert "| **Coverage** | ❌ Inadequate |" in md and "- note\n" in md and "_None_" in md


def test_critic_report(spark):
    df = spark.createDataFrame([(5, "PASS", [("d", "a.py", 2, 0.875)], 2, "ok")],
                               f"pr_id long, s string, f array<{FIND}>, v int, summ string")
    md = df.select(G.critic_report(F.col("pr_id"), F.col("s"), F.col("f"), F.col("v"), F.col("summ"))).first()[0]
    assert "> **Overall verdict: ✅ Pass**" in md
    assert "> 🧹 **2 finding(s) vetoed**" in md
    assert "| `a.py` | 2 | 88% | d |" in md


def test_cost_is_latency_based(spark):
    assert abs(one(spark, V.cost_estimate(F.lit(10.0))) - 0.004) < 1e-12


def test_findings_type_roundtrip(spark):
    assert spark.range(1).select(F.array().cast(FINDINGS_TYPE)).schema.fields[0].dataType.simpleString() == FINDINGS_TYPE


def test_pipeline_latency_caps_timed_out_agents(spark):
    res = spark.createDataFrame([(1, "security", 60.0), (1, "architecture", 10.0), (1, "testing", 5.0),
                                 (1, "critic", 3.0)], "pr_id long, agent string, elapsed_s double")
    assert rows(V.pipeline_latency(res), "latency_s") == [(43.0,)]  # slowest reviewer cut at 40 s + critic


def test_result_document_shapes(spark):
    import json
    from reviewlake.operators.contracts import FINDINGS_TYPE as FT
    res = spark.createDataFrame([
        (3, "security", "ok", "pass", "low", None, None, None, None, None, []),
        (3, "architecture", "timeout", "fail", None, None, None, None, None, "Timeout", None),
        (3, "testing", "failed", "warn", None, None, False, None, None, "x", [("Testing evaluation failed: x", "N/A", 0, 1.0)]),
    ], f"pr_id long, agent string, outcome string, status string, severity_level string, complexity_score int, "
       f"test_coverage_adequate boolean, vetoed_count int, summary string, error string, findings {FT}")
    rep = spark.createDataFrame([(3, "# md")], "pr_id long, markdown_report string")
    doc = json.loads(G.result_document(rep, res).first()["document"])
    assert doc["pr_id"] == 3 and doc["summary"] == G.DEFAULT_SUMMARY and doc["markdown_report"] == "# md"
    assert doc["results"]["security"] == {"status": "pass", "severity_level": "low", "findings_summary": []}
    assert doc["results"]["architecture"] == {"error": "Timeout", "status": "fail", "agent": "architecture"}
    assert doc["results"]["testing"]["qa_notes"][0]["file_reference"] == "N/A"
    assert doc["results"]["critic"] == {}


def test_fallback_report_like_the_service_tests(spark):
    # worst status across the three reviewers, id in the title, sections and _None_ for empty lists
    res = spark.createDataFrame([(42, "security", "pass"), (42, "architecture", "pass"), (42, "testing", "pass")],
                                "pr_id long, agent string, status string")
    piv = res.groupBy("pr_id").agg(*[F.first(F.when(F.col("agent") == a, F.struct(
        "status", F.lit(None).cast("string").alias("severity_level"), F.lit(None).cast("int").alias("complexity_score"),
        F.lit(True).alias("test_coverage_adequate"), F.array().cast(f"array<{FIND}>").alias("findings"))),
        ignorenulls=True).alias(a) for a in ["security", "architecture", "testing"]])
    md = piv.select(G.agent_report(F.col("pr_id"), F.col("security"), F.col("architecture"), F.col("testing"),
                                   "2024-01-01 00:00 UTC")).first()[0]
    assert "PR #42" in md and "**Overall result: ✅ Pass**" in md and md.count("_None_") == 3
    for section in ("Security Analysis", "Architecture Review", "Testing Evaluation"):
        assert section in md


def test_numbers_round_as_python_prints_them(spark):
    xs = [0.125, 1.005, 1.015, 2.675, 0.0, 0.005, 79.995, 123456.78905, 0.00005, 1e-9, 39.99999]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", G.fixed(F.col("x"), 2), G.fixed(F.col("x"), 4))
    assert [tuple(r)[1:] for r in df.collect()] == [(f"{x:.2f}", f"{x:.4f}") for x in xs]


def test_fallback_report_full_text(spark):
    res = spark.createDataFrame([
        (9, "security", "warn", "medium", None, None, [("leak", "a.py", 3, 0.5), ("plain", None, None, None)]),
        (9, "architecture", "pass", None, 3, None, []), (9, "testing", "fail", None, None, True, [])],
        f"pr_id long, agent string, status string, severity_level string, complexity_score int, "
        f"test_coverage_adequate boolean, findings array<{FIND}>")
    piv = res.groupBy("pr_id").agg(*[F.first(F.when(F.col("agent") == a, F.struct(
        "status", "severity_level", "complexity_score", "test_coverage_adequate", "findings")), ignorenulls=True).alias(a)
        for a in ["security", "architecture", "testing"]])
    md = piv.select(G.agent_report(F.col("pr_id"), F.col("security"), F.col("architecture"), F.col("testing"), "T")).first()[0]
    assert md == """## 🤖 Automated Code Review — PR #9

> **Overall result: ❌ Fail** &nbsp;|&nbsp; _T_

---

### 🔒 Security Analysis &nbsp;⚠️ Warn

| Field | Value |
|---|---|
| **Status** | ⚠️ Warn |
| **Severity Level** | `medium` |

**Findings:**
- leak — `a.py` line 3 — confidence: 50%
- plain

---

### 🏛️ Architecture Review &nbsp;✅ Pass

| Field | Value |
|---|---|
| **Status** | ✅ Pass |
| **Complexity Score** | `3 / 10` |

**Refactor Suggestions:**
_None_

---

### 🧪 Testing Evaluation &nbsp;❌ Fail

| Field | Value |
|---|---|
| **Status** | ❌ Fail |
| **Coverage** | ✅ Adequate |

**QA Notes:**
_None_

---

<sub>Generated by reviewlake · T</sub>
"""


def test_audit_log_makes_its_rows_once_for_both_commits(spark, tmp_path, monkeypatch):
    from reviewlake.plans import q_reports as Q
    made = spark.range(5).select(F.col("id").alias("pr_id"), F.lit("ok").alias("critic_outcome"), F.lit("pass").alias("worst_status"),
                                 F.lit(1.0).alias("latency_s"), F.expr("uuid()").alias("report_md5"))
    monkeypatch.setattr(Q, "audit_rows", lambda *_: made)
    monkeypatch.setattr(Q, "scratch_path", lambda *_: str(tmp_path / "audit"))
    assert Q.audit_log(spark, "").count() == 5
    committed = spark.read.parquet(str(tmp_path / "audit" / "data"))
    assert committed.count() == 10 and committed.select("audit_json").distinct().count() == 5
