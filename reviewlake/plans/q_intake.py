"""Registered queries over webhook intake (A) on the F1 deliveries fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake as I
from ..session import scratch_path, spread
from ..sources import fixtures as fx
from ..sources import io
from . import oracle_fixtures as O
from .catalog import register

KEY = fx.FIXTURE_KEY
_IPAD, _OPAD = fx.hmac_pads(KEY)

_ROUTE_SQL = f"""{O.F1},
r0 AS (SELECT *, coalesce(signature_header = concat('sha256=', sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}')
  || encode(raw_body))))), false) AS sig_ok,
  TRY_CAST(raw_body AS JSON) AS j FROM deliveries),
r1 AS (SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS is_obj,
  CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.action') END AS action FROM r0),
routed AS (SELECT *, CASE WHEN NOT sig_ok THEN '401' WHEN NOT is_obj THEN '400'
  WHEN coalesce(action IN ('opened', 'synchronize'), false) = false THEN 'ignored' ELSE 'accepted' END AS outcome FROM r1),
routed2 AS (SELECT *, CASE outcome WHEN '401' THEN '{I.UNAUTHORIZED_REASON}' WHEN '400' THEN '{I.BAD_JSON_REASON}'
  WHEN 'ignored' THEN concat('Action ''', coalesce(action, 'None'), ''' not processed') END AS reason FROM routed),
pr AS (SELECT delivery_id,
  CASE WHEN json_type(j, '$.pull_request.number') IS NULL OR json_type(j, '$.pull_request.number') = 'NULL'
    THEN 'unknown' ELSE json_extract_string(j, '$.pull_request.number') END AS pr_id,
  coalesce(nullif(json_extract_string(j, '$.pull_request.title'), ''), '') AS title,
  coalesce(json_extract_string(j, '$.repository.full_name'), '') AS repo_name,
  coalesce(nullif(json_extract_string(j, '$.pull_request.diff_url'), ''), '') AS diff_url
  FROM routed2 WHERE outcome = 'accepted')"""


def _routed(spark, sf_dir):
    return I.route_deliveries(spread(fx.deliveries(spark, sf_dir)), KEY)


@register("delivery_routing", f"""WITH {_ROUTE_SQL}
SELECT delivery_id, sig_ok, outcome, reason FROM routed2""")
def delivery_routing(spark, sf_dir):
    """A2 + A3: signature check, strict JSON, action filter -> outcome per delivery."""
    return _routed(spark, sf_dir).select("delivery_id", "sig_ok", "outcome", "reason")


@register("delivery_outcomes", f"""WITH {_ROUTE_SQL}
SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM routed2 GROUP BY outcome""")
def delivery_outcomes(spark, sf_dir):
    """A3 rolled up: deliveries per outcome (partial aggregation, 4 groups)."""
    return _routed(spark, sf_dir).groupBy("outcome").agg(F.count("*").cast("bigint").alias("n"))


@register("pr_intake", f"""WITH {_ROUTE_SQL} SELECT * FROM pr""")
def pr_intake(spark, sf_dir):
    """A4: accepted deliveries projected to PR rows with defaults."""
    r = _routed(spark, sf_dir)
    return I.project_pr(r.filter(F.col("outcome") == "accepted"))


def _diff_table(spark, sf_dir):
    p = fx.prs(spark, sf_dir)
    return p.select(F.concat(F.lit("https://example.invalid/"), F.col("pr_id").cast("string"), F.lit(".diff"))
                    .alias("diff_url"), "diff")


@register("pr_with_diff", f"""WITH {O.F0}, {_ROUTE_SQL},
d AS (SELECT concat('https://example.invalid/', pr_id, '.diff') AS u, diff FROM prs),
j AS (SELECT pr.*, coalesce(d.diff, '') AS diff FROM pr LEFT JOIN d ON pr.diff_url = d.u)
SELECT delivery_id, pr_id, CAST(length(diff) AS BIGINT) AS diff_len, md5(diff) AS diff_md5 FROM j""")
def pr_with_diff(spark, sf_dir):
    """A5: accepted PRs joined to landed diffs by URL; missing diff -> ''."""
    r = _routed(spark, sf_dir)
    prs = I.project_pr(r.filter(F.col("outcome") == "accepted"))
    j = I.attach_diff(prs, _diff_table(spark, sf_dir))
    return j.select("delivery_id", "pr_id", F.length("diff").cast("bigint").alias("diff_len"),
                    F.md5("diff").alias("diff_md5"))


@register("deliverable_reports", f"""WITH {_ROUTE_SQL}
SELECT delivery_id, pr_id, repo_name FROM pr WHERE repo_name <> '' AND pr_id <> 'unknown'""")
def deliverable_reports(spark, sf_dir):
    """PRs whose report can be posted (repo known, number known)."""
    r = _routed(spark, sf_dir)
    return I.deliverable(I.project_pr(r.filter(F.col("outcome") == "accepted"))).select(
        "delivery_id", "pr_id", "repo_name")


@register("delivered_runs", f"""WITH {_ROUTE_SQL},
ok AS (SELECT delivery_id, pr_id, repo_name FROM pr WHERE repo_name <> '' AND pr_id <> 'unknown')
SELECT 'posted' AS target, CASE WHEN delivery_id % 2 = 0 THEN 'even' ELSE '007' END AS run_id, * FROM ok
UNION ALL SELECT 'dry_run', 'even', * FROM ok WHERE delivery_id % 2 = 0""")
def delivered_runs(spark, sf_dir):
    """A6 sink: two runs posted and one dry run, the first run written three times (once with half of
    its rows, as by a job that was started with less input); each row is read back once."""
    path = scratch_path(spark, "delivered")
    ok = deliverable_reports(spark, sf_dir)
    odd = F.coalesce(F.pmod("delivery_id", F.lit(2)) == 1, F.lit(False))  # a null id goes with the even ones
    for rows, run in ((ok.where(~odd & (F.pmod("delivery_id", F.lit(4)) == 0)), "even"), (ok.where(~odd), "even"), (ok.where(odd), "007"),
                      (ok.where(~odd), "even")):
        io.write_reports(rows, path, run_id=run)
    logged = io.write_reports(ok.where(~odd), path, dry_run=True, run_id="even")
    cols = ["run_id", "delivery_id", "pr_id", "repo_name"]
    return (io.read_runs(spark, path).select(F.lit("posted").alias("target"), *cols)
            .unionByName(io.read_runs(spark, logged).select(F.lit("dry_run").alias("target"), *cols)))
