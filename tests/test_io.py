import tempfile

from pyspark.sql import functions as F

from conftest import rows
from reviewlake.sources import io


def test_scan_deliveries_batch_schema(spark):
    base = tempfile.mkdtemp(prefix="rl-io-")
    spark.createDataFrame([(1, "{}", None)], io.DELIVERY_SCHEMA).write.mode("overwrite").parquet(f"{base}/d")
    df = io.scan_deliveries(spark, f"{base}/d")
    assert df.schema.simpleString() == "struct<delivery_id:bigint,raw_body:string,signature_header:string>"
    assert df.count() == 1


def test_write_reports_dry_run_goes_to_log_table(spark):
    base = tempfile.mkdtemp(prefix="rl-io-")
    df = spark.createDataFrame([("7", "o/r", "# report")], "pr_id string, repo_name string, markdown_report string")
    target = io.write_reports(df, f"{base}/reports", dry_run=True)
    assert target == f"{base}/reports_dryrun"
    assert rows(spark.read.parquet(target), "pr_id") == [("7",)]
    assert io.write_reports(df, f"{base}/reports") == f"{base}/reports"


def test_write_audit_appends_json(spark):
    base = tempfile.mkdtemp(prefix="rl-io-")
    df = spark.createDataFrame([(1, "fail")], "pr_id long, worst_status string")
    io.write_audit(df, f"{base}/audit")
    io.write_audit(df, f"{base}/audit")
    got = spark.read.parquet(f"{base}/audit")
    assert got.count() == 2
    assert rows(got.select(F.get_json_object("audit_json", "$.worst_status")).distinct()) == [("fail",)]


def test_a_run_counts_once_and_a_dead_attempt_not_at_all(spark):
    path = tempfile.mkdtemp(prefix="rl-io-") + "/runs"

    def frame(*ids):
        return spark.createDataFrame([(i,) for i in ids], "id long")

    def read():
        return sorted((r.run_id, r.id) for r in io.read_runs(spark, path).collect())
    io.commit_run(frame(1, 2), path, "007")
    io.commit_run(frame(5), path, "b")
    io.commit_run(frame(1, 2, 3), path, "007")  # the same run again, with one row more
    assert read() == [("007", 1), ("007", 2), ("007", 3), ("b", 5)]
    before = spark.read.parquet(f"{path}/manifest").count()
    dead = frame(99).withColumns({"run_id": F.lit("007"), "attempt": F.lit("dead")})
    dead.write.mode("append").partitionBy("run_id", "attempt").parquet(f"{path}/data")  # died before its manifest row
    assert spark.read.parquet(f"{path}/manifest").count() == before and ("007", 99) not in read()
    io.commit_run(frame(), path, "b")  # a run without rows replaces what the run had
    assert read() == [("007", 1), ("007", 2), ("007", 3)]


def test_sinks_with_a_run_id_survive_reruns(spark):
    base = tempfile.mkdtemp(prefix="rl-io-")
    df = spark.createDataFrame([("7", "o/r", "# report")], "pr_id string, repo_name string, markdown_report string")
    for _ in range(2):
        for dry in (False, True):
            target = io.write_reports(df, f"{base}/reports", dry_run=dry, run_id="1")
            assert rows(io.read_runs(spark, target), "pr_id", "run_id") == [("7", "1")]
        io.write_audit(df, f"{base}/audit", run_id="1")
    assert rows(io.read_runs(spark, f"{base}/audit").select(F.get_json_object("audit_json", "$.repo_name"))) == [("o/r",)]
