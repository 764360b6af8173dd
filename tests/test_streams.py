import tempfile

from pyspark.sql import functions as F

from conftest import rows
from reviewlake.operators import diffs as D
from reviewlake.operators import privacy as PV
from reviewlake.streaming import streams as S


def test_stream_sanitize_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="rl-stream-")
    diffs = [(1, "diff --git a/x.py b/x.py\n@@ -0,0 +1,1 @@\n+mail a@b.io key password=abcdefg\n"),
             (2, "diff --git a/yarn.lock b/yarn.lock\n+l\n"), (3, "")]
    df = spark.createDataFrame(diffs, "pr_id long, diff string")
    df.write.mode("overwrite").parquet(f"{base}/in")
    q = S.start_sanitize(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    streamed = dict(rows(spark.read.parquet(f"{base}/out"), "pr_id", "sanitized_diff"))
    batch = dict(rows(PV.sanitize(D.guard_diff(df)), "pr_id", "sanitized_diff"))
    assert streamed == batch
    assert streamed[1].endswith("<EMAIL_ADDRESS> key <REDACTED_SECRET>\n") and streamed[2] == ""


def test_stream_intake_replay_is_idempotent(spark):
    from reviewlake.operators.intake import expected_signature_sql
    base = tempfile.mkdtemp(prefix="rl-intake-")
    body = '{"action":"opened","pull_request":{"number":1},"repository":{"full_name":"o/r"}}'
    df = spark.createDataFrame([(1, body)], "delivery_id long, raw_body string").withColumn(
        "signature_header", F.expr(expected_signature_sql("raw_body", "k")))
    df.write.mode("overwrite").parquet(f"{base}/in")
    for _ in range(2):  # second run resumes from the checkpoint: nothing new, nothing duplicated
        S.stream_intake(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", "k").awaitTermination()
    assert rows(spark.read.parquet(f"{base}/out/accepted"), "pr_id") == [("1",)]


def test_every_delivery_lands_in_one_half(spark, tmp_path, monkeypatch):
    from reviewlake.plans import q_streams as Q
    df = spark.createDataFrame([(i,) for i in (None, None, -3, -2, -1, 0, 1, 2, 3)], "delivery_id long")
    landed = []
    monkeypatch.setattr(Q.fx, "deliveries", lambda spark, sf_dir: df)
    monkeypatch.setattr(Q.S, "stream_intake", lambda spark, landing, *a, **k: landed.append(landing) or type("Q", (), {"awaitTermination": lambda self: None})())
    Q._intake(spark, str(tmp_path))
    assert sorted(map(str, rows(spark.read.parquet(landed[0])))) == sorted(map(str, rows(df)))


def test_segments_follow_from_the_number_of_batches():
    for fan in (2, 3, 8):
        for n in range(200):
            found = S.segments(n, fan)
            assert [b for level, k in found for b in range(k * fan ** level, (k + 1) * fan ** level)] == list(range(n))
            assert max((sum(s[0] == level for s in found) for level, _ in found), default=0) < fan


def _scanned(df):
    """Rows that the scans of a plan without exchanges gave."""
    df.collect()
    todo, n = [df._jdf.queryExecution().executedPlan()], 0
    leaves = todo[0].collectLeaves()
    for i in range(leaves.length()):
        n += leaves.apply(i).metrics().apply("numOutputRows").value()
    return n


def test_attempts_log_merges_replays_and_reads_touched_ranges_only(spark, tmp_path):
    base, fan, span = f"{tmp_path}/log", 2, 10
    want = []
    for b in range(9):
        batch = [(b * 20 + i, f"{b}") for i in range(20)] + [(5, f"late {b}"), (None, "no id")]
        want += batch
        df = spark.createDataFrame(batch, "pr_id long, note string")
        for _ in range(1 + b % 2):  # every other batch is replayed
            S.append_attempts(df, base, b, span, fan)
        assert sorted(rows(S.read_attempts(spark, base, b + 1, df.schema, fan)), key=str) == sorted(want, key=str)
    kept = sorted((p.parent.name, p.name) for p in tmp_path.glob("log/level=*/segment=*"))
    assert kept == [("level=0", "segment=8"), ("level=3", "segment=0")]
    touched = S.read_attempts(spark, base, 9, df.schema, fan, [4, 17])
    assert sorted(rows(touched)) == sorted(r for r in want if r[0] is not None and r[0] // span in (4, 17))
    assert _scanned(touched) == 20  # of 198 rows


def test_stream_reports_reads_the_batch_s_ranges_of_every_table(spark, tmp_path, monkeypatch):
    read = []
    whole = S.read_attempts
    monkeypatch.setattr(S, "read_attempts", lambda *a: read.append(a[-1]) or whole(*a))
    for pr in (3, 25, 26, 90):
        spark.createDataFrame([(pr, "critic", 1, "primary", 1.0, "no json", None, None)], S.AGENT_OUTPUT_SCHEMA).coalesce(1) \
            .write.mode("append").parquet(f"{tmp_path}/in")
    prs = spark.createDataFrame([(i, f"diff {i}") for i in range(100)], "pr_id long, sanitized_diff string")
    scans = prs.select("pr_id", F.lit("").alias("scan_summary"))
    ranged = [S.read_ranged(spark, S.write_ranged(t, f"{tmp_path}/{n}", 10), t.schema) for n, t in (("p", prs), ("s", scans))]
    S.stream_reports(spark, f"{tmp_path}/in", *ranged, f"{tmp_path}/out", f"{tmp_path}/ckpt", "now", max_files_per_trigger=1,
                     span=10, fan=2).awaitTermination()
    assert sorted(map(tuple, read)) == [(0,), (2,), (2,), (9,)]
    assert sorted(rows(S.latest_reports(spark, f"{tmp_path}/out"), "pr_id")) == [(3,), (25,), (26,), (90,)]


def test_touched_diffs_are_counted_before_they_are_joined(spark):
    prs = spark.createDataFrame([(1, "a\nb", 0), (2, None, 0), (3, "", 1), (4, "x\n", 1), (5, "y", 2)], "pr_id long, sanitized_diff string, pr_range long")
    touched = spark.createDataFrame([(1,), (2,), (4,), (5,), (9,)], "pr_id long")
    got = S.of_touched(S.counted(prs), touched, [0, 1])
    assert sorted(rows(got, "pr_id", "n_lines")) == [(1, 2), (2, 0), (4, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("sanitized_diff")  # no text meets the join
    join = plan.splitlines()[[i for i, x in enumerate(plan.splitlines()) if "Join" in x][0] + 1]
    assert "Project" in join and "CASE WHEN" in join


def test_ids_far_apart_share_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "RANGES", 4, raising=False)
    ids = [i * 1_000_003 * 10 for i in range(-10, 20)] + [None]
    df = spark.createDataFrame([(i, f"note {i}") for i in ids], "pr_id long, note string")
    S.append_attempts(df, f"{tmp_path}/log", 0, 10, 2)
    assert len([p for p in tmp_path.glob("log/level=0/segment=0/pr_range=*") if "HIVE_DEFAULT" not in p.name]) <= 4
    assert sorted(rows(S.read_attempts(spark, f"{tmp_path}/log", 1, df.schema, 2)), key=str) == sorted(rows(df), key=str)
    hit = [r[0] for r in df.where("pr_id = 30000090").select(S.pr_range(10)).collect()]
    found = S.read_attempts(spark, f"{tmp_path}/log", 1, df.schema, 2, hit)
    assert (30000090, "note 30000090") in rows(found) and found.count() < len(ids)


def test_tables_with_a_folder_per_range_are_still_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "RANGES", 4, raising=False)
    old = spark.createDataFrame([(5, 0), (70, 7), (90, 9), (110, 11)], "pr_id long, pr_range long")
    touched = spark.createDataFrame([(70,), (90,)], "pr_id long")
    hit = [r[0] for r in touched.select(S.pr_range(10)).distinct().collect()]
    assert sorted(rows(S.of_touched(old, touched, hit), "pr_id")) == [(70,), (90,)]


def test_lines_counted_with_the_table_are_not_counted_from_the_diffs_again(spark):
    prs = spark.createDataFrame([(1, "a\nb", 2, 0), (2, "c", 1, 0)], "pr_id long, sanitized_diff string, n_lines int, pr_range long")
    got = S.counted(prs)
    assert sorted(rows(got, "pr_id", "n_lines")) == [(1, 2), (2, 1)]
    assert "sanitized_diff" not in got._jdf.queryExecution().analyzed().toString().splitlines()[0]
    assert "CASE WHEN" not in got._jdf.queryExecution().optimizedPlan().toString()  # no count
