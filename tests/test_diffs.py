import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from reviewlake.functions import patterns as P
from reviewlake.functions.text import count_splitlines
from reviewlake.operators import diffs as D


def hunk(path, body, prefixed=True):
    a, b = ("a/", "b/") if prefixed else ("", "")
    n = body.count("\n")
    return f"diff --git {a}{path} {b}{path}\n--- /dev/null\n+++ {b}{path}\n@@ -0,0 +1,{n} @@\n{body}"


DIFF = (hunk("src/app.py", "+x = 1\n+y = 2\n") + hunk("package-lock.json", "+{}\n")
        + hunk("dist/app.min.js", "+a\n", prefixed=False) + hunk("vendor/lib.py", "+v\n")
        + hunk("web/logo.svg", "+<svg/>\n"))


def model_filter(diff, patterns):
    """Our Python model of the guardrail: split before 'diff --git ' lines, drop hunks
    whose first line matches, rejoin, cap."""
    pieces = re.split(r"(?=^diff --git )", diff, flags=re.MULTILINE)
    kept = [h for h in pieces if not any(re.search(p, h.split("\n", 1)[0], re.I) for p in patterns)]
    out = "".join(kept)
    if len(out) > P.MAX_DIFF_LENGTH:
        out = out[:P.MAX_DIFF_LENGTH] + P.TRUNCATION_MARKER
    return out


def test_literal_mode_matches_model(spark):
    df = spark.createDataFrame([(1, DIFF)], "pr_id long, diff string")
    got = rows(D.guard_diff(df, mode="literal"), "capped_diff")[0][0]
    assert got == model_filter(DIFF, P.BLOAT_HEADER_PATTERNS)
    # the header patterns need a space before the name: only the unprefixed minified file goes
    assert "package-lock.json" in got and "dist/app.min.js" not in got


def test_path_mode_drops_lock_vendor_dist_svg(spark):
    df = spark.createDataFrame([(1, DIFF)], "pr_id long, diff string")
    got = rows(D.guard_diff(df), "capped_diff")[0][0]
    assert got == hunk("src/app.py", "+x = 1\n+y = 2\n")
    st = rows(D.guardrail_stats(df), "n_hunks", "n_dropped", "truncated")[0]
    assert st == (5, 4, False)


def test_cap_appends_marker_and_counts_code_points(spark):
    body = "+" + "é" * 13000 + "\n"
    d = hunk("src/big.py", body)
    df = spark.createDataFrame([(1, d)], "pr_id long, diff string")
    got = rows(D.guard_diff(df, max_len=P.MAX_DIFF_LENGTH), "capped_diff")[0][0]
    assert got == d[:12000] + P.TRUNCATION_MARKER
    assert len(got) > P.MAX_DIFF_LENGTH


def test_empty_diff_stays_empty(spark):
    df = spark.createDataFrame([(1, "")], "pr_id long, diff string")
    assert rows(D.guard_diff(df), "capped_diff")[0][0] == ""
    assert rows(D.guardrail_stats(df), "n_hunks", "n_dropped")[0] == (0, 0)


def test_table_cap_equals_row_cap(spark):
    big = "".join(hunk(f"src/m{i}.py", "+" + "z" * 3000 + "\n") for i in range(6)) + hunk("yarn.lock", "+l\n")
    df = spark.createDataFrame([(1, big), (2, hunk("yarn.lock", "+l\n")), (3, "")], "pr_id long, diff string")
    a = dict(rows(D.guard_diff(df, max_len=P.MAX_DIFF_LENGTH), "pr_id", "capped_diff"))
    b = dict(rows(D.cap_diff(D.drop_bloat(D.split_hunks(df)), df), "pr_id", "capped_diff"))
    assert a == b
    assert b[2] == "" and b[1].endswith(P.TRUNCATION_MARKER)


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "a\rb", "a\x0bb\x0cc", "a b ",
                                  "a\x85b", "\n\n", "x\x1cy\x1dz\x1e", "a\n\r\nb"])
def test_splitlines_count(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert rows(df.select(count_splitlines(F.col("t"))))[0][0] == len(text.splitlines())


def test_diff_lines_numbering(spark):
    d = ("diff --git a/f.py b/f.py\n--- a/f.py\n+++ b/f.py\n@@ -1,3 +1,6 @@\n ctx\n-old\n+new1\n+new2\n ctx2\n"
         "@@ -20,2 +22,2 @@\n-gone\n+here\n\\ No newline at end of file\n")
    df = spark.createDataFrame([(1, d)], "pr_id long, diff string")
    lines = D.diff_lines(D.split_hunks(df)).filter(F.col("sign") != "h").orderBy("pos")
    got = rows(lines, "sign", "new_line", "text")
    assert got == [(" ", 1, "ctx"), ("-", None, "old"), ("+", 2, "new1"), ("+", 3, "new2"), (" ", 4, "ctx2"),
                   ("-", None, "gone"), ("+", 22, "here"), ("\\", None, "\\ No newline at end of file"),
                   ("?", None, "")]
    files = rows(D.changed_files(D.diff_lines(D.split_hunks(df))), "path", "added", "removed", "is_test")
    assert files == [("f.py", 3, 2, False)]


def test_large_pr_rule(spark):
    from reviewlake.operators.contracts import FINDINGS_TYPE
    arch = spark.createDataFrame([(1, "pass"), (2, "fail"), (3, "pass")], "pr_id long, status string") \
        .withColumn("findings", F.array().cast(FINDINGS_TYPE))
    big = "+x\n" * 401
    prs = spark.createDataFrame([(1, big), (2, big), (3, "+x\n")], "pr_id long, sanitized_diff string")
    out = D.apply_large_pr_rule(arch, prs).orderBy("pr_id")
    got = rows(out, "pr_id", "status", "is_large", F.size("findings"))
    assert got == [(1, "warn", True, 1), (2, "fail", True, 1), (3, "pass", False, 0)]
    again = D.apply_large_pr_rule(out.drop("n_lines", "is_large"), prs).orderBy("pr_id")
    assert rows(again, F.size("findings")) == [(1,), (1,), (0,)]  # the note is added once


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_NAMES = ["src/a.py", "package-lock.json", "x/yarn.lock", "dist/app.js", "vendor/v.go", "img/logo.svg", "a.min.js",
          "gen/x_pb2.py", "doc.generated.ts", "my file.map", "ünïcode.py"]
_BODY = st.text(alphabet="ab +-\r é\n", max_size=30)


@st.composite
def _diff(draw):
    parts = []
    if draw(st.booleans()):
        parts.append(draw(_BODY))  # text before the first header
    for _ in range(draw(st.integers(0, 4))):
        name = draw(st.sampled_from(_NAMES))
        a, b = ("a/", "b/") if draw(st.booleans()) else ("", "")
        parts.append(f"diff --git {a}{name} {b}{name}{draw(st.sampled_from(['', chr(13)]))}\n{draw(_BODY)}\n")
    return "".join(parts)


@settings(max_examples=15, deadline=None)
@given(st.lists(_diff(), min_size=1, max_size=8))
def test_literal_guard_matches_python_model(spark, diffs):
    df = spark.createDataFrame(list(enumerate(diffs)), "pr_id long, diff string")
    got = dict(rows(D.guard_diff(df, mode="literal"), "pr_id", "capped_diff"))
    assert got == {i: model_filter(d, P.BLOAT_HEADER_PATTERNS) for i, d in enumerate(diffs)}


def _lines(spark, diff):
    df = spark.createDataFrame([(1, diff)], "pr_id long, diff string")
    return D.diff_lines(D.split_hunks(df))


@pytest.mark.parametrize("text,path", [
    ("diff --git a/x.py b/x.py\r\n--- a/x.py\r\n+++ b/x.py\r\n@@ -1 +1 @@\r\n+y\r\n", "x.py"),
    ("diff --git a/a/my file.py b/a/my file.py\n--- a/a/my file.py\t\n+++ b/a/my file.py\t\n@@ -1 +1 @@\n+y\n", "a/my file.py"),
    ("diff --git a/a/my file.py b/a/my file.py\nBinary files differ\n", "a/my file.py"),
    ('diff --git "a/q b.py" "b/q b.py"\n--- "a/q b.py"\n+++ "b/q b.py"\n@@ -1 +1 @@\n+y\n', "q b.py"),
    ("diff --git a/old.py b/new.py\nsimilarity index 90%\nrename from old.py\nrename to new.py\n", "new.py"),
    ("diff --git a/gone.py b/gone.py\n--- a/gone.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-y\n", "gone.py"),
    ("diff --git src/x.py src/x.py\n--- src/x.py\n+++ src/x.py\n@@ -1 +1 @@\n+++ b/other.py\n", "src/x.py"),
    ("no header\n", "")])
def test_paths(spark, text, path):
    df = spark.createDataFrame([(1, text)], "pr_id long, diff string")
    assert rows(D.split_hunks(df), "path") == [(path,)]


def test_empty_context_lines_count_and_huge_numbers_are_null(spark):
    d = "diff --git a/f b/f\n+++ b/f\n@@ -1,3 +7,4 @@\n one\n\n+two\n"
    got = rows(_lines(spark, d).filter("sign <> 'h'").orderBy("pos"), "sign", "new_line", "text")
    assert got == [(" ", 7, "one"), (" ", 8, ""), ("+", 9, "two"), ("?", None, "")]
    big = "diff --git a/f b/f\n+++ b/f\n@@ -0,0 +99999999999,1 @@\n+x\n@@ -0,0 +99999999999999999999,1 @@\n+y\n@@ -0,0 +5 @@\n+z\n"
    got = rows(_lines(spark, big).filter("sign = '+'").orderBy("pos"), "new_line", "text")
    assert got == [(99999999999, "x"), (None, "y"), (5, "z")]


def test_line_table_has_no_shuffle(spark):
    plan = _lines(spark, "diff --git a/f b/f\n@@ -1 +1 @@\n+x\n")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_line_ranges_hold_every_new_side_line(spark):
    d = "diff --git a/f b/f\n+++ b/f\n@@ -1,2 +3,3 @@\n a\n-b\n+c\n\n@@ -9 +20 @@\n+d\n@@ -30 +30,0 @@\n-e\n"
    df = D.split_hunks(spark.createDataFrame([(1, d)], "pr_id long, diff string"))
    (ranges,) = rows(D.line_ranges(df), "ranges")[0]
    held = {n for r in ranges for n in range(r["lo"], r["hi"] + 1)}
    assert held == {n for (n,) in rows(D.diff_lines(df).filter("new_line IS NOT NULL"), "new_line")} == {3, 4, 5, 20}


def test_whole_diffs_by_default(spark):
    d = hunk("src/big.py", "+" + "z" * 13000 + "\n")
    df = spark.createDataFrame([(1, d)], "pr_id long, diff string")
    assert rows(D.guard_diff(df), "capped_diff") == [(d,)]
