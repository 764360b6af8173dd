"""One query's shared building blocks.

A review query touches the same derived tables several times (the PR diffs, their line
table, scan findings, sanitized diffs, validated attempts). Building each once per
query and handing the same DataFrame to every consumer gives Spark identical plan
fragments, so their shuffles are planned and run once (exchange / query-stage reuse).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import diffs as D
from ..operators import privacy as PV
from ..sources import fixtures as fx


class ReviewContext:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @cached_property
    def prs(self) -> DataFrame:
        return fx.prs(self.spark, self.sf_dir)

    @cached_property
    def hunks(self) -> DataFrame:
        return D.split_hunks(self.prs)

    @cached_property
    def lines(self) -> DataFrame:
        return D.diff_lines(self.hunks)

    @cached_property
    def scan_hits(self) -> DataFrame:
        # Only hunks that can hold a rule hit are exploded into lines (map-side screen).
        screened = PV.screen_hunks(self.hunks, [p for *_, p in PV.SECRET_RULES], PV.SECRET_WORDS)
        return PV.secret_findings(D.diff_lines(screened))

    @cached_property
    def scans(self) -> DataFrame:
        return PV.scan_summary(PV.filter_severity(self.scan_hits), self.prs)

    @cached_property
    def sanitized(self) -> DataFrame:
        return PV.sanitize(D.guard_diff(self.prs))

    @cached_property
    def line_ranges(self) -> DataFrame:
        return D.line_ranges(self.hunks)

    @cached_property
    def validated(self) -> DataFrame:
        # Shuffle the attempt log on (pr_id, agent) first: validation (CPU-heavy per
        # row) runs on every core, and attempt resolution reuses this partitioning.
        # An explicit count (the cluster's shuffle width): AQE would otherwise coalesce
        # this small, highly compressible shuffle into one CPU-bound task.
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        log = fx.agent_outputs(self.spark, self.sf_dir).repartition(n, "pr_id", "agent")
        return C.classify_attempts(C.validate_reports(C.parse_reports(log)))

    @cached_property
    def resolved(self) -> DataFrame:
        return C.resolve_attempts(self.validated.drop(*C.ATTEMPT_TEXTS))

    @cached_property
    def results(self) -> DataFrame:
        """Per-(PR, agent) results for the PRs with landed outputs (D12 + D13)."""
        return C.with_defaults(self.resolved, self.scans)

    @cached_property
    def final(self) -> DataFrame:
        """Results for every PR with the large-PR rule applied (D12 + B5)."""
        return C.final_results(self.resolved, self.scans, self.sanitized)
