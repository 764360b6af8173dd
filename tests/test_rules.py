from conftest import rows
from reviewlake.operators import critic as E
from reviewlake.operators import rules as H

SCHEMA = "pr_id long, hunk_no int, pos int, path string, sign string, new_line int, text string"


def test_line_rules_and_network(spark):
    lines = spark.createDataFrame([
        (1, 0, 1, "tests/test_a.py", "+", 1, "    time.sleep(2)"),
        (1, 0, 2, "src/a.py", "+", 1, "time.sleep(2)"),
        (1, 0, 3, "src/a.py", "+", 2, "subprocess.run(cmd, shell=True)"),
        (1, 1, 1, "tests/test_b.py", "+", 5, "r = requests.get(url)"),
        (1, 2, 1, "tests/test_c.py", "+", 5, "r = requests.get(url)"),
        (1, 2, 2, "tests/test_c.py", " ", 6, "@mock.patch('x')"),
    ], SCHEMA)
    got = sorted(rows(H.rule_findings(lines).unionByName(H.unmocked_network(lines)), "rule_id", "file_reference",
                      "line_number"))
    assert got == [("hardcoded-sleep-in-test", "tests/test_a.py", 1), ("shell-true", "src/a.py", 2),
                   ("unmocked-network-in-test", "tests/test_b.py", 5)]


def test_duplicate_blocks_across_prs(spark):
    block = ["alpha = 1", "beta = 2", "gamma = 3", "delta = 4", "omega = 5"]
    added = "@@ -0,0 +1,5 @@\n" + "".join(f"+{t}\n" for t in block)
    hunks = spark.createDataFrame([(1, "f1.py", added), (2, "f2.py", added), (3, "g.py", "@@ -0,0 +1 @@\n+alpha = 1\n")],
                                  "pr_id long, path string, hunk string")
    got = rows(H.duplicate_blocks(hunks), "n_occurrences", "first_pr_id", "first_line")
    assert got == [(2, 1, 1)]


def test_dependencies(spark):
    lines = spark.createDataFrame([(1, 0, 1, "requirements.txt", "+", 1, "requests==2.31.0"),
                                   (1, 1, 1, "package.json", "+", 4, '  "left-pad": "^1.3.0",'),
                                   (1, 2, 1, "src/x.py", "+", 1, "a==b")], SCHEMA)
    assert sorted(rows(H.added_dependencies(lines), "dependency")) == [("left-pad",), ("requests",)]


def test_coverage_gap(spark):
    files = spark.createDataFrame([(1, "src/a.py", False), (2, "src/a.py", False), (2, "tests/test_a.py", True),
                                   (3, "README.md", False)], "pr_id long, path string, is_test boolean")
    assert dict(rows(H.coverage_gap(files), "pr_id", "coverage_adequate")) == {1: False, 2: True, 3: True}


def test_veto_and_merge(spark):
    f = spark.createDataFrame([
        (1, "security", 0, "Bad  thing", "a.py", 2, 0.4), (1, "testing", 0, "bad thing", "a.py", 2, 0.9),
        (1, "testing", 1, "x", "gone.py", 1, 0.9), (1, "architecture", 0, "y", "a.py", 50, 0.9),
        (1, "architecture", 1, "z", "N/A", 0, 1.0), (1, "architecture", 2, "w", "a.py", 5, 0.3)],
        "pr_id long, agent string, ord int, description string, file_reference string, line_number int, "
        "confidence_score double")
    files = spark.createDataFrame([(1, "a.py", [(1, 9)])], "pr_id long, path string, ranges array<struct<lo:bigint,hi:bigint>>")
    v = dict(((a, b), c) for a, b, c in rows(E.veto(f, files), "agent", "ord", "veto"))
    assert v == {("security", 0): "approved", ("testing", 0): "approved", ("testing", 1): "absent_file",
                 ("architecture", 0): "unlinked_line", ("architecture", 1): "approved", ("architecture", 2): "approved"}
    assert dict(((a, b), c) for a, b, c in rows(E.veto(f, files, tolerance=41), "agent", "ord", "veto"))[
        ("architecture", 0)] == "approved"
    m = rows(E.merge_duplicates(f.filter("file_reference = 'a.py' and line_number = 2")), "agents", "confidence_score")
    assert m == [("security,testing", 0.9)]
    isl = sorted(rows(E.merge_overlapping(f.filter("file_reference = 'a.py'"), k=3), "first_line", "last_line"))
    assert isl == [(2, 5), (50, 50)]


def test_hunk_screen_keeps_every_hit(spark):
    from reviewlake.operators import diffs as D
    from reviewlake.operators import privacy as PV
    diff = ("diff --git a/Dockerfile b/Dockerfile\n@@ -0,0 +1,2 @@\n+RUN x\n+FROM python:latest\n"
            "diff --git a/tests/test_n.py b/tests/test_n.py\n@@ -0,0 +1,2 @@\n+x = 1\n+time.sleep(1)\n"
            "diff --git a/src/ok.py b/src/ok.py\n@@ -0,0 +1,1 @@\n+print('hi')\n")
    hunks = D.split_hunks(spark.createDataFrame([(1, diff)], "pr_id long, diff string"))
    full = D.diff_lines(hunks)
    sec = [p for *_, p in PV.SECRET_RULES]
    line = [p for *_, p in H.LINE_RULES] + [H.NETWORK]
    screened_sec = PV.secret_findings(D.diff_lines(PV.screen_hunks(hunks, sec)))
    assert sorted(rows(screened_sec)) == sorted(rows(PV.secret_findings(full)))
    assert rows(screened_sec, "rule_id") == [("docker-latest-tag",)]
    screened = D.diff_lines(PV.screen_hunks(hunks, line))
    assert sorted(rows(H.rule_findings(screened))) == sorted(rows(H.rule_findings(full)))
    assert PV.screen_hunks(hunks, sec).count() == 1 and PV.screen_hunks(hunks, line).count() == 1


def test_prefilter_drops_line_anchors_only():
    from reviewlake.operators.privacy import hunk_prefilter
    assert hunk_prefilter([r"(?i)^\s*FROM\s+x$", r"[^$^]\$"]) == r"(?:(?i)\s*FROM\s+x)|(?:[^$^]\$)"
