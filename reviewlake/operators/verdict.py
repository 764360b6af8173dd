"""Verdict aggregates (F): worst status, mean confidence, max severity, cost and the
governance metrics rows. All are group-bys on ``pr_id`` with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P


def status_rank(c) -> F.Column:
    """pass 0, warn 1, fail 2; anything else (unknown, 'maybe', NULL) ranks as fail."""
    lc = F.lower(c)
    return F.when(lc == "pass", 0).when(lc == "warn", 1).otherwise(2)


def worst_agg() -> F.Column:
    """Aggregate over one PR's agent rows: struct (rank, tie, status) of the worst of the security /
    architecture / testing statuses. A missing agent counts as 'fail'; ties keep the first agent
    in that order; the status keeps its original spelling."""
    ranked = []
    for i, agent in enumerate(P.REVIEW_AGENTS):
        st = F.coalesce(F.first(F.when(F.col("agent") == agent, F.col("status")), ignorenulls=True), F.lit("fail"))
        ranked.append(F.struct(status_rank(st).alias("rank"), F.lit(-i).alias("tie"), st.alias("status")))
    return F.array_max(F.array(*ranked))


def worst_status(results: DataFrame, prs: DataFrame | None = None) -> DataFrame:
    """per PR, the worst reviewer status (see :func:`worst_agg`), in one group-by; a PR of
    ``prs`` without any result is 'fail'."""
    w = results.filter(F.col("agent").isin(*P.REVIEW_AGENTS)).groupBy("pr_id").agg(worst_agg().alias("w"))
    w = w.select("pr_id", F.col("w.status").alias("worst_status"), F.col("w.rank").alias("worst_rank"))
    if prs is None:
        return w
    return prs.select("pr_id").distinct().join(w, "pr_id", "left").select(
        "pr_id", F.coalesce("worst_status", F.lit("fail")).alias("worst_status"), F.coalesce("worst_rank", F.lit(2)).alias("worst_rank"))


def mean_confidence(critic: DataFrame) -> DataFrame:
    """F2: mean confidence of the critic's approved findings (missing score = 0.0),
    NULL when there are none. ``critic``: ``pr_id, findings``."""
    x = critic.select("pr_id", F.explode_outer("findings").alias("f"))
    score = F.when(F.col("f").isNotNull(), F.coalesce(F.col("f.confidence_score"), F.lit(0.0)))
    return x.groupBy("pr_id").agg(F.avg(score).alias("mean_confidence"))


def _severity_map() -> F.Column:
    return F.create_map(*[x for i, s in enumerate(P.SEVERITY_LEVELS) for x in (F.lit(s), F.lit(i))])


def max_severity(df: DataFrame, col: str = "severity") -> DataFrame:
    """highest severity per PR (low < medium < high < critical; others ignored)."""
    s = F.lower(F.col(col))
    r = F.try_element_at(_severity_map(), s)
    return df.filter(r.isNotNull()).groupBy("pr_id").agg(
        F.max(F.struct(r.alias("rank"), s.alias("level"))).alias("m")).select(
        "pr_id", F.col("m.level").alias("max_severity"))


def cost_estimate(latency) -> F.Column:
    """the cost proxy is latency times a fixed rate (not tokens)."""
    return latency * F.lit(P.COST_PER_SECOND_USD)


def latency_agg(sla_seconds: float = P.SUBAGENT_TIMEOUT_SECONDS) -> F.Column:
    """Aggregate over one PR's agent rows: slowest of the three parallel reviewers plus
    the critic. A node is cut off at the SLA, so a timed-out agent adds the limit."""
    t = F.least(F.col("elapsed_s"), F.lit(sla_seconds))
    return (F.coalesce(F.max(F.when(F.col("agent").isin(*P.REVIEW_AGENTS), t)), F.lit(0.0))
            + F.coalesce(F.max(F.when(F.col("agent") == "critic", t)), F.lit(0.0)))


def pipeline_latency(results: DataFrame, sla_seconds: float = P.SUBAGENT_TIMEOUT_SECONDS) -> DataFrame:
    """Per PR pipeline latency (see :func:`latency_agg`)."""
    return results.groupBy("pr_id").agg(latency_agg(sla_seconds).alias("latency_s"))


def review_metrics(latency: DataFrame, mean_conf: DataFrame) -> DataFrame:
    """governance metric rows ``pr_id, metric, value``; the mean-confidence row is
    left out when NULL."""
    x = latency.join(mean_conf, "pr_id", "left")
    arr = F.array(
        F.struct(F.lit("latency_s").alias("metric"), F.col("latency_s").alias("value")),
        F.struct(F.lit("cost_usd").alias("metric"), cost_estimate(F.col("latency_s")).alias("value")),
        F.struct(F.lit("mean_confidence").alias("metric"), F.col("mean_confidence").alias("value")))
    y = x.select("pr_id", F.explode(F.filter(arr, lambda m: m["value"].isNotNull())).alias("m"))
    return y.select("pr_id", F.col("m.metric").alias("metric"), F.col("m.value").alias("value"))
