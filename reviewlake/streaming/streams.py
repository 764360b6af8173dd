"""Structured Streaming operators (S): intake, per-event sanitizing and report updates.

All three read file streams with a fixed schema. Writes go through ``foreachBatch``
into folders partitioned by ``batch_id`` with dynamic partition overwrite, so a
micro-batch replayed after a failure replaces its own output instead of duplicating
it; the checkpoint records progress. Nothing keeps per-key state in memory: report
updates re-read the attempts of the PRs a batch touched from the attempts table.

The attempts table is a log of segments in levels, each in folders by range of PR ids. A batch
writes a segment of level 0; when ``fan`` segments of a level are full they are merged into one of
the next. Which segments hold the batches 0 to n follows from n + 1 written in base ``fan``, so at
most (fan - 1) * log(n) are read, nothing is listed and a replayed batch makes the same segments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import contracts as C
from ..operators import diffs as D
from ..operators import intake as I
from ..operators import privacy as PV
from ..operators import report as G
from ..sources.io import scan_deliveries

PRS_SCHEMA = "pr_id BIGINT, diff STRING"
RANGES = 512  # folders of a table by range at most, however far apart its PRs' ids are
AGENT_OUTPUT_SCHEMA = ("pr_id BIGINT, agent STRING, attempt INT, provider STRING, latency_s DOUBLE, "
                       "raw_text STRING, error STRING, error_type STRING")


def _write_batch(df: DataFrame, path: str, batch_id: int, extra_partitions=()) -> None:
    (df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*extra_partitions, "batch_id").parquet(path))


def pr_range(span: int, col: str = "pr_id") -> F.Column:
    """Number of the range of ``span`` ids that a PR lies in, dealt over ``RANGES`` numbers in turn. PRs come
    in the order of their ids, so the PRs of a batch lie in few ranges, and its reads leave the others'
    folders alone; ids far apart, each in a range of its own, still share ``RANGES`` folders."""
    return F.expr(f"pmod(`{col}` div {int(span)}L, {RANGES}L)").alias("pr_range")


def in_ranges(ranges: list[int]) -> F.Column:
    """Rows of folders of :func:`pr_range` in ``ranges``; a table written before the numbers were dealt in
    turn has larger ones."""
    return F.pmod("pr_range", F.lit(RANGES)).isin(ranges)


def write_ranged(df: DataFrame, path: str, span: int) -> str:
    """``df`` in folders by :func:`pr_range`, each file sorted by PR; a range with many rows gets several
    files. :func:`stream_reports` reads of such tables only the ranges that a batch touches."""
    (df.withColumn("pr_range", pr_range(span)).hint("rebalance", "pr_range").sortWithinPartitions("pr_range", "pr_id")
     .write.mode("overwrite").partitionBy("pr_range").parquet(path))
    return path


def read_ranged(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of :func:`write_ranged`; ``schema`` has the columns besides ``pr_range``."""
    fields = [f for f in schema.fields if f.name != "pr_range"]
    return spark.read.schema(T.StructType([*fields, T.StructField("pr_range", T.LongType())])).parquet(path)


def segments(n: int, fan: int) -> list[tuple[int, int]]:
    """(level, number) of the segments that hold the first ``n`` batches, oldest first: the segment
    ``k`` of level ``l`` holds the batches from ``k * fan ** l`` on, ``fan ** l`` of them."""
    found, level = [], 0
    while n:
        found += [(level, k) for k in range(n - 1, n - n % fan - 1, -1)]
        n, level = n // fan, level + 1
    return found[::-1]


def _segment(base: str, level: int, number: int) -> str:
    return f"{base}/level={level}/segment={number}"


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def append_attempts(attempts: DataFrame, base: str, batch_id: int, span: int, fan: int) -> None:
    """Add a batch to the attempts log and merge the levels that it fills. The segments that the batch
    before merged are removed only now: until that batch was done, a replay would have needed them."""
    spark = attempts.sparkSession
    write_ranged(attempts, _segment(base, 0, batch_id), span)
    level, number = 0, batch_id
    while number % fan == fan - 1:
        parts = [read_ranged(spark, _segment(base, level, k), attempts.schema) for k in range(number - fan + 1, number + 1)]
        level, number = level + 1, number // fan
        write_ranged(reduce(DataFrame.unionByName, parts).drop("pr_range"), _segment(base, level, number), span)
    before, held = set(segments(batch_id, fan)), set(segments(max(0, batch_id - 1), fan)) | {(0, batch_id - 1)}
    level, number = 0, batch_id - 1
    while batch_id and number % fan == fan - 1:  # what the batch before merged, level by level
        held |= {(level, k) for k in range(number - fan + 1, number + 1)}
        level, number = level + 1, number // fan
    for level, number in held - before if batch_id else ():
        _remove(spark, _segment(base, level, number))


def read_attempts(spark: SparkSession, base: str, batches: int, schema, fan: int, ranges: list[int] | None = None) -> DataFrame:
    """The attempts of the first ``batches`` batches, of all PRs or those in ``ranges``."""
    log = reduce(DataFrame.unionByName, [read_ranged(spark, _segment(base, *s), schema) for s in segments(batches, fan)])
    return (log if ranges is None else log.filter(in_ranges(ranges))).drop("pr_range")


def counted(prs: DataFrame, diff_col: str = "sanitized_diff") -> DataFrame:
    """Each PR with the number of its diff's lines in place of the diff (and its range, where it has one).
    Lines that were counted when the table was written (``n_lines``) are not counted again from the texts."""
    lines = F.col("n_lines") if "n_lines" in prs.columns else D.line_count(F.col(diff_col)).alias("n_lines")
    return prs.select("pr_id", lines, *(c for c in prs.columns if c == "pr_range"))


def of_touched(t: DataFrame, touched: DataFrame, ranges: list[int]) -> DataFrame:
    """The rows of the PRs in ``touched`` (distinct ids). An inner join: Spark moves a semi join below what
    ``t`` computes, and its shuffle would then carry the texts and not what was made of them."""
    if "pr_range" in t.columns:
        t = t.filter(in_ranges(ranges)).drop("pr_range")
    return t.join(touched, "pr_id")


def _trigger(w, available_now: bool, interval: str):
    return w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)


def stream_intake(spark: SparkSession, in_path: str, out_path: str, ckpt: str, secret: str | None,
                  available_now: bool = True, interval: str = "30 seconds", max_files_per_trigger: int | None = None):
    """A1-A4 on a file stream of deliveries; accepted PR rows to ``out/accepted``,
    everything else to ``out/rejects``. Stateless append; returns the StreamingQuery."""
    src = scan_deliveries(spark, in_path, streaming=True, max_files_per_trigger=max_files_per_trigger)

    def batch(df: DataFrame, batch_id: int) -> None:
        routed = I.route_deliveries(df, secret).persist()
        try:
            _write_batch(I.project_pr(routed.filter(F.col("outcome") == "accepted")), f"{out_path}/accepted", batch_id)
            _write_batch(routed.filter(F.col("outcome") != "accepted").select(
                "delivery_id", "outcome", "reason"), f"{out_path}/rejects", batch_id)
        finally:
            routed.unpersist()

    w = src.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
    return _trigger(w, available_now, interval).start()


def stream_sanitize(stream_df: DataFrame, diff_col: str = "diff", mode: str = "path") -> DataFrame:
    """Guardrail + entity and secret masking per event, as a streaming DataFrame.
    Pure per-row expressions (array split / filter / join, regexp_replace), so it runs
    in append mode without watermark or state. (Dictionary PERSON masking and span
    listing regroup rows; run those inside ``foreachBatch``.)"""
    g = D.guard_diff(stream_df, diff_col, "capped_diff", mode)
    return PV.sanitize(g, "capped_diff", "sanitized_diff").drop("capped_diff")


def start_sanitize(spark: SparkSession, in_path: str, out_path: str, ckpt: str, available_now: bool = True,
                   interval: str = "30 seconds"):
    src = spark.readStream.schema(PRS_SCHEMA).parquet(in_path)
    out = stream_sanitize(src).drop("diff")
    w = out.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt) \
        .outputMode("append")
    return _trigger(w, available_now, interval).start()


def stream_reports(spark: SparkSession, in_path: str, prs: DataFrame, scans: DataFrame, out_path: str, ckpt: str,
                   ts: str, available_now: bool = True, interval: str = "30 seconds",
                   max_files_per_trigger: int | None = None, span: int = 4096, fan: int = 8):
    """S3: landed agent outputs -> validated attempts (a segment per batch) -> for the PRs
    a batch touched, all their attempts so far are resolved, defaulted and rendered, and
    the reports written under the batch id. ``prs`` holds the sanitized diffs (static), and best the number
    of their lines as ``n_lines``, else each batch reads its PRs' diffs to count them; ``scans`` the scan summaries; where they come from :func:`write_ranged` with the same ``span``, only
    the touched ranges of them are read, as of the attempts. ``span`` and ``fan`` stay the same for the life
    of ``out_path``. Read the newest report per PR with :func:`latest_reports`."""
    r = spark.readStream.schema(AGENT_OUTPUT_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    src = r.parquet(in_path)
    attempts_path = f"{out_path}/attempts"

    def batch(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            one_batch(df, batch_id)
        finally:
            df.unpersist()

    def one_batch(df: DataFrame, batch_id: int) -> None:
        v = C.classify_attempts(C.validate_reports(C.parse_reports(df))).drop(*C.ATTEMPT_TEXTS)
        append_attempts(v, attempts_path, batch_id, span, fan)
        touched = df.select("pr_id").where("pr_id IS NOT NULL").distinct()
        # The numbers of the touched ranges reach the driver, one per range and not per PR: the
        # scans of attempts, diffs and scan summaries are pruned to their folders.
        hit = [r[0] for r in touched.select(pr_range(span)).distinct().collect()]

        log = read_attempts(spark, attempts_path, batch_id + 1, v.schema, fan, hit).join(touched, "pr_id", "left_semi")
        res = C.final_results(C.resolve_attempts(log), of_touched(scans, touched, hit), of_touched(counted(prs), touched, hit))
        rep = G.assemble_reports(res, None, ts)
        _write_batch(rep, f"{out_path}/reports", batch_id)

    w = src.writeStream.foreachBatch(batch).option("checkpointLocation", ckpt)
    return _trigger(w, available_now, interval).start()


def latest_reports(spark: SparkSession, out_path: str) -> DataFrame:
    """Newest report per PR across batches (one partial-aggregated group-by)."""
    r = spark.read.parquet(f"{out_path}/reports")
    cols = [c for c in r.columns if c not in ("pr_id", "batch_id")]
    m = r.groupBy("pr_id").agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("r"))
    return m.select("pr_id", *[F.col(f"r.{c}").alias(c) for c in cols])
