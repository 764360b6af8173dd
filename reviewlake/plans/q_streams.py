"""Registered streaming queries (S): each lands its Spark-derived input under the
shared checkpoint folder, runs the stream to completion (``availableNow``) and reads
the sink back. Same results as the batch queries, so they share their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diffs as D
from ..session import scratch_path
from ..sources import fixtures as fx
from ..streaming import streams as S
from .catalog import ORACLES, register
from .context import ReviewContext
from .q_reports import REPORT_TS


SPAN = 4096  # PR ids per folder of the S3 tables


def _land(df, path, mode="overwrite"):
    df.write.mode(mode).parquet(path)
    return path


def half_of(col):
    """0 or 1 for any row, of a null or negative id too."""
    return F.pmod(F.xxhash64(col), F.lit(2))


def _intake(spark, sf_dir):
    base = scratch_path(spark, "stream-intake")
    deliveries, landing = fx.deliveries(spark, sf_dir), f"{base}/landing"
    for half in (0, 1):  # two landings, so that at least two micro-batches run
        _land(deliveries.filter(half_of("delivery_id") == half), landing, "append")
    files = max(1, len(spark.read.parquet(landing).inputFiles()) // 2)
    S.stream_intake(spark, landing, f"{base}/out", f"{base}/ckpt", fx.FIXTURE_KEY, max_files_per_trigger=files).awaitTermination()
    return f"{base}/out"


@register("stream_intake")
def stream_intake(spark, sf_dir):
    """Webhook deliveries as a file stream -> routed; accepted PR rows read back."""
    return spark.read.parquet(f"{_intake(spark, sf_dir)}/accepted").drop("batch_id")


@register("stream_rejects")
def stream_rejects(spark, sf_dir):
    """What the same stream turned away, with its reasons."""
    return spark.read.parquet(f"{_intake(spark, sf_dir)}/rejects").drop("batch_id")


@register("stream_sanitize")
def stream_sanitize(spark, sf_dir):
    """PR diffs as a file stream -> guardrail and masking per event, append sink."""
    base = scratch_path(spark, "stream-sanitize")
    landing = _land(fx.prs(spark, sf_dir), f"{base}/landing")
    q = S.start_sanitize(spark, landing, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.select("pr_id", F.length("sanitized_diff").cast("bigint").alias("sanitized_len"),
                      F.md5("sanitized_diff").alias("sanitized_md5"))


@register("stream_reports")
def stream_reports(spark, sf_dir):
    """S3: agent outputs arrive over several micro-batches (one file per attempt
    number); each batch re-resolves the PRs it touched; the newest report wins. Two segments of
    a level make one of the next, so that three batches merge."""
    base = scratch_path(spark, "stream-reports")
    ctx = ReviewContext(spark, sf_dir)
    lines = D.line_count(F.col("sanitized_diff")).alias("n_lines")  # counted once, not by each batch
    san, scans = ctx.sanitized.select("pr_id", "sanitized_diff", lines), ctx.scans
    san_path, scan_path = S.write_ranged(san, f"{base}/prs", SPAN), S.write_ranged(scans, f"{base}/scans", SPAN)
    outputs, landing = fx.agent_outputs(spark, sf_dir), f"{base}/landing"
    for attempt in (1, 2, 3):  # as they come in, attempt after attempt
        _land(outputs.filter(F.col("attempt") == attempt), landing, "append")
    files = max(1, len(spark.read.parquet(landing).inputFiles()) // 3)
    q = S.stream_reports(spark, landing, S.read_ranged(spark, san_path, san.schema), S.read_ranged(spark, scan_path, scans.schema),
                         f"{base}/out", f"{base}/ckpt", REPORT_TS, max_files_per_trigger=files, span=SPAN, fan=2)
    q.awaitTermination()
    rep = S.latest_reports(spark, f"{base}/out")
    return rep.select("pr_id", "critic_outcome", F.length("markdown_report").cast("bigint").alias("report_len"),
                      F.md5("markdown_report").alias("report_md5"))


def _share_oracles():
    from . import q_intake, q_privacy, q_reports  # noqa: F401
    ORACLES["stream_intake"] = ORACLES["pr_intake"]
    ORACLES["stream_rejects"] = f"""WITH {q_intake._ROUTE_SQL}
SELECT delivery_id, outcome, reason FROM routed2 WHERE outcome <> 'accepted'"""
    ORACLES["stream_sanitize"] = ORACLES["sanitized_diffs"]
    ORACLES["stream_reports"] = (ORACLES["reports"].rsplit("FROM md", 1)[0]
                                 + "FROM md WHERE pr_id IN (SELECT DISTINCT doc_id // 4 FROM documents)")


_share_oracles()
