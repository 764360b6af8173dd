"""Webhook intake operators: signature check, routing, PR projection, diff attach,
deliverable filter, result document and audit rows. Row-wise projections except the
diff attach (one equi-join on the diff URL, skew handled by AQE)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import patterns as P
from ..sources.fixtures import hmac_pads

# Fixed outcome details of the webhook endpoint.
UNAUTHORIZED_REASON = "Invalid webhook signature"
BAD_JSON_REASON = "Invalid JSON payload"


def expected_signature_sql(body: str, secret: str) -> str:
    """``'sha256=' + HMAC-SHA256(secret, body)`` composed from ``sha2`` with the inner
    and outer pads as binary literals (no HMAC built-in in Spark)."""
    ipad, opad = hmac_pads(secret)
    return (f"concat('sha256=', sha2(concat(X'{opad}', unhex(sha2(concat(X'{ipad}', "
            f"encode({body}, 'UTF-8')), 256))), 256))")


def verify_signature(df: DataFrame, secret: str | None, body: str = "raw_body",
                     header: str = "signature_header") -> DataFrame:
    """A2: ``sig_ok``. No secret configured: every delivery passes; missing header: fails."""
    if not secret:
        return df.withColumn("sig_ok", F.lit(True))
    ok = F.expr(f"coalesce({header} = {expected_signature_sql(body, secret)}, false)")
    return df.withColumn("sig_ok", ok)


def route_deliveries(df: DataFrame, secret: str | None, body: str = "raw_body",
                     header: str = "signature_header") -> DataFrame:
    """A3: ordered outcomes. Bad signature -> '401'; body not one JSON object -> '400';
    action not opened/synchronize -> 'ignored' with reason; else 'accepted'. The
    signature is checked before parsing. Adds ``payload`` (VARIANT), ``outcome``, ``reason``."""
    J.python_json_semantics(df.sparkSession)
    x = verify_signature(df, secret, body, header)
    x = x.withColumn("payload", F.expr(J.strict_parse_sql(body)))
    action = F.expr(J.str_val("payload", "$.action"))
    shown = F.expr(J.py_str_sql("payload", "$.action"))
    is_obj = F.expr(J.is_object("payload"))
    acts = F.lit(None).cast("string")
    outcome = (F.when(~F.col("sig_ok"), F.lit("401"))
               .when(F.col("payload").isNull() | ~is_obj, F.lit("400"))
               .when(~F.coalesce(action.isin(*P.REVIEW_ACTIONS), F.lit(False)), F.lit("ignored"))
               .otherwise(F.lit("accepted")))
    reason = (F.when(outcome == "401", F.lit(UNAUTHORIZED_REASON))
              .when(outcome == "400", F.lit(BAD_JSON_REASON))
              .when(outcome == "ignored",
                    F.concat(F.lit("Action '"), F.coalesce(shown, F.lit("None")), F.lit("' not processed")))
              .otherwise(acts))
    return x.withColumn("outcome", outcome).withColumn("reason", reason)


def project_pr(accepted: DataFrame) -> DataFrame:
    """A4: PR fields with the endpoint's defaults (number -> 'unknown', title / repo /
    diff_url -> ''). An explicit ``number: null`` also becomes 'unknown'."""
    v = "payload"
    num_t = J.vtype(v, "$.pull_request.number")
    number = F.expr(f"CASE WHEN {num_t} IS NULL OR {num_t} = 'VOID' THEN 'unknown' "
                    f"ELSE {J.py_str_sql(v, '$.pull_request.number')} END")
    title = F.expr(f"coalesce(nullif({J.str_val(v, '$.pull_request.title')}, ''), '')")
    repo = F.expr(f"coalesce({J.str_val(v, '$.repository.full_name')}, '')")
    url = F.expr(f"coalesce(nullif({J.str_val(v, '$.pull_request.diff_url')}, ''), '')")
    return accepted.select("delivery_id", number.alias("pr_id"), title.alias("title"),
                           repo.alias("repo_name"), url.alias("diff_url"))


def attach_diff(prs: DataFrame, diffs: DataFrame, url_col: str = "diff_url", hot_rows: int = 100_000) -> DataFrame:
    """A5: bring the diff text to each PR by its URL; no diff -> '' and processing goes on.

    A diff that landed more than once counts once (of different texts the greatest). Texts are
    exchanged once, by URL and salt: each task keeps one text per URL, the exchange brings them together and
    the join takes the same partitioning. A URL of more than ``hot_rows`` PRs is dealt over that many
    more salts, its text sent to each. Only the first URLs by count are, as many as there are shuffle
    partitions; any other has fewer rows than a task's even share, so the list that is broadcast has
    that many rows, of two numbers each. PRs without a URL meet no text and are spread.
    """
    width = int(prs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    url, h = F.col(url_col), F.xxhash64(url_col)
    hot = (prs.where(url.isNotNull()).groupBy(h.alias("__h")).agg(F.count("*").alias("__n"))
           .where(F.col("__n") > hot_rows).orderBy(F.desc("__n"), "__h").limit(width)
           .select("__h", F.least(F.ceil(F.col("__n") / hot_rows), F.lit(width)).cast("int").alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))

    def with_salts(df):
        return df.withColumn("__h", h).join(F.broadcast(hot), "__h", "left")

    texts = (with_salts(diffs.where(url.isNotNull()).select(url_col, "diff"))
             .select(url.alias("__url"), F.col("diff").alias("__diff"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt"))
             .groupBy("__url", "__salt").agg(F.max("__diff").alias("__diff")))
    salted = with_salts(prs).withColumn("__salt", F.pmod(F.xxhash64(*prs.columns), F.when(url.isNull(), F.lit(width)).otherwise(salts)).cast("int"))
    j = salted.join(texts.hint("merge"), (url == F.col("__url")) & (salted["__salt"] == texts["__salt"]), "left")
    return j.select(*[prs[c] for c in prs.columns], F.coalesce(F.col("__diff"), F.lit("")).alias("diff"))


def deliverable(df: DataFrame) -> DataFrame:
    """Only reviews that can be posted (a repo and a known PR number)."""
    return df.filter((F.col("repo_name") != "") & (F.col("pr_id") != "unknown"))


def audit_rows(df: DataFrame) -> DataFrame:
    """One audit record per finished review; raw and masked diffs are never selected."""
    drop = {"diff", "raw_diff", "sanitized_diff", "capped_diff", "raw_body", "payload"}
    keep = [c for c in df.columns if c not in drop]
    return df.select(*keep)
