"""Critic-stage operators (E): converge agent results, veto findings that the diff does
not support, merge duplicates and overlapping findings, downgrade unsupported
severities, count approvals and tier confidences.

Vetoes are one join against the changed files on ``(pr_id, path)``; a file's row carries its
new-side line ranges, so the line test, with or without tolerance, is made in the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P

NO_FILE = ["", "N/A"]


def converge(results: DataFrame) -> DataFrame:
    """One row per PR with the three reviewer results side by side (missing -> NULL
    struct, read as ``{}``). A partial-aggregated group-by on ``pr_id``."""
    cols = [c for c in results.columns if c not in ("pr_id", "agent")]
    aggs = [F.first(F.when(F.col("agent") == a, F.struct(*cols)), ignorenulls=True).alias(a) for a in P.ALL_AGENTS]
    return results.groupBy("pr_id").agg(*aggs, F.count("*").cast("bigint").alias("n_results"))


def normalise_text(c) -> F.Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def veto(findings: DataFrame, files: DataFrame, tolerance: int = 0) -> DataFrame:
    """E2 + E3: tag each finding ``approved`` / ``absent_file`` / ``unlinked_line``.

    A finding naming a file (not ''/'N/A') that the PR did not change is vetoed; a finding
    with ``line_number > 0`` in a changed file must hit a new-side line of the diff (context
    or added), within ``tolerance`` lines. ``files``: ``pr_id, path, ranges`` (changed files
    with their new-side line ranges), one row per file, so one join on (pr, file) decides both.
    """
    has_file = F.col("file_reference").isNotNull() & ~F.col("file_reference").isin(*NO_FILE)
    fk = files.select("pr_id", F.col("path").alias("file_reference"), F.col("ranges").alias("__ranges"))
    x = findings.join(fk, ["pr_id", "file_reference"], "left")
    line = F.col("line_number")
    near = F.exists("__ranges", lambda r: (line >= r["lo"] - tolerance) & (line <= r["hi"] + tolerance))
    status = (F.when(~has_file, F.lit("approved"))
              .when(F.col("__ranges").isNull(), F.lit("absent_file"))
              .when((F.coalesce(line, F.lit(0)) > 0) & ~near, F.lit("unlinked_line"))
              .otherwise(F.lit("approved")))
    return x.withColumn("veto", status).drop("__ranges")


def merge_duplicates(findings: DataFrame) -> DataFrame:
    """Same (pr, file, line, normalised text) across agents -> one finding with the
    max confidence and the sorted agent list. Partial aggregation on the merge key."""
    k = findings.withColumn("norm", normalise_text(F.col("description")))
    return k.groupBy("pr_id", "file_reference", "line_number", "norm").agg(
        F.min("description").alias("description"),
        F.max("confidence_score").alias("confidence_score"),
        F.array_join(F.sort_array(F.collect_set("agent")), ",").alias("agents"),
        F.count("*").cast("bigint").alias("n_merged"))


def merge_overlapping(findings: DataFrame, k: int = 3) -> DataFrame:
    """E5: findings in one file whose lines are at most ``k`` apart form one island
    (gaps-and-islands: ``lag`` + running ``sum``).

    Islands depend only on the distinct line numbers, so findings are first reduced to
    one row per (pr, file, line) with partial aggregation; the window then orders the
    distinct lines of one file (bounded by that file's diff), however many findings pile
    onto a single file or line."""
    x = findings.filter(F.coalesce(F.col("line_number"), F.lit(0)) > 0)
    per_line = x.groupBy("pr_id", "file_reference", "line_number").agg(
        F.count("*").alias("__n"), F.max("confidence_score").alias("__conf"))
    w = Window.partitionBy("pr_id", "file_reference").orderBy("line_number")
    y = per_line.withColumn("__gap", (F.col("line_number") - F.lag("line_number").over(w)) > k)
    y = y.withColumn("island", F.sum(F.coalesce(F.col("__gap"), F.lit(True)).cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return y.groupBy("pr_id", "file_reference", "island").agg(
        F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line"),
        F.sum("__n").cast("bigint").alias("n_findings"), F.max("__conf").alias("confidence_score"))


def downgrade(security: DataFrame, scans: DataFrame) -> DataFrame:
    """A high / critical security severity without any HIGH / CRITICAL scan hit for
    the PR drops one level. ``scans``: ``pr_id, severity`` rule hits."""
    hits = scans.filter(F.upper("severity").isin("HIGH", "CRITICAL")).select("pr_id").distinct() \
        .withColumn("__hit", F.lit(True))
    x = security.join(hits, "pr_id", "left")
    sev = F.lower(F.col("severity_level"))
    down = F.when(sev == "critical", F.lit("high")).when(sev == "high", F.lit("medium"))
    return x.withColumn("final_severity", F.when(down.isNotNull() & F.col("__hit").isNull(), down)
                        .otherwise(F.col("severity_level"))).withColumn(
        "downgraded", down.isNotNull() & F.col("__hit").isNull()).drop("__hit")


def critic_counts(vetted: DataFrame) -> DataFrame:
    """E7 + E8: approved and vetoed findings and approved hints (confidence below 0.5) per PR."""
    return vetted.groupBy("pr_id").agg(
        F.count_if(F.col("veto") == "approved").cast("bigint").alias("approved_count"),
        F.count_if(F.col("veto") != "approved").cast("bigint").alias("vetoed_count"),
        F.count_if((F.col("veto") == "approved") & (confidence_tier(F.col("confidence_score")) == "hint"))
        .cast("bigint").alias("n_hints"))


def confidence_tier(c) -> F.Column:
    """Scores below 0.5 are hints."""
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c < 0.5, F.lit("hint")).otherwise(F.lit("finding"))
