import hashlib
import hmac

from pyspark.sql import functions as F

from conftest import rows
from reviewlake.operators import intake as I

KEY = "s3cret"


def sig(body, key=KEY):
    return "sha256=" + hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()


def test_hmac_equals_python(spark):
    bodies = ['{"a":1}', "héllo wörld", "", "x" * 500]
    df = spark.createDataFrame([(i, b, sig(b)) for i, b in enumerate(bodies)], "delivery_id long, raw_body string, "
                                                                               "signature_header string")
    assert [r[0] for r in I.verify_signature(df, KEY).select("sig_ok").collect()] == [True] * 4
    long_key = "k" * 100  # keys longer than a block are hashed first
    df2 = spark.createDataFrame([(1, "b", sig("b", long_key))], "delivery_id long, raw_body string, signature_header string")
    assert rows(I.verify_signature(df2, long_key), "sig_ok") == [(True,)]


def test_routing_order_and_reasons(spark):
    good = '{"action":"opened","pull_request":{"number":7,"title":null},"repository":{"full_name":"o/r"}}'
    data = [
        (1, good, sig(good)),
        (2, "not json", "sha256=bad"),          # signature first: 401, not 400
        (3, "not json", sig("not json")),
        (4, '{"a":1} trailing', sig('{"a":1} trailing')),
        (5, '[1,2]', sig("[1,2]")),
        (6, '{"action":"closed"}', sig('{"action":"closed"}')),
        (7, '{"x":1}', sig('{"x":1}')),
        (8, good, None),
        (9, '{"action":"synchronize","pull_request":{"number":null}}', sig('{"action":"synchronize","pull_request":{"number":null}}')),
    ]
    df = spark.createDataFrame(data, "delivery_id long, raw_body string, signature_header string")
    r = I.route_deliveries(df, KEY)
    got = dict((a, (b, c)) for a, b, c in rows(r, "delivery_id", "outcome", "reason"))
    assert got[1] == ("accepted", None)
    assert got[2][0] == "401" and got[8][0] == "401"
    assert got[3][0] == "400" and got[4][0] == "400" and got[5][0] == "400"
    assert got[6] == ("ignored", "Action 'closed' not processed")
    assert got[7] == ("ignored", "Action 'None' not processed")
    prs = dict((a, (b, c, d)) for a, b, c, d in rows(I.project_pr(r.filter(F.col("outcome") == "accepted")),
                                                    "delivery_id", "pr_id", "title", "repo_name"))
    assert prs == {1: ("7", "", "o/r"), 9: ("unknown", "", "")}
    assert rows(I.deliverable(I.project_pr(r.filter(F.col("outcome") == "accepted"))), "delivery_id") == [(1,)]


def test_no_secret_accepts_all_signatures(spark):
    df = spark.createDataFrame([(1, "{}", None)], "delivery_id long, raw_body string, signature_header string")
    assert rows(I.verify_signature(df, None), "sig_ok") == [(True,)]


def test_attach_diff_defaults_empty(spark):
    prs = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "")], "delivery_id long, diff_url string")
    diffs = spark.createDataFrame([("u1", "D1")], "diff_url string, diff string")
    got = dict(rows(I.attach_diff(prs, diffs), "delivery_id", "diff"))
    assert got == {1: "D1", 2: "", 3: ""}


def test_attach_diff_salts_hot_urls(spark):
    prs = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"u{i}") for i in range(300)] + [(300, "hot")] * 2,
                                "delivery_id long, diff_url string")
    diffs = spark.createDataFrame([("hot", "A"), ("hot", "B"), ("hot", "B"), (None, "N"), ("u6", "D6"), ("u12", None)],
                                  "diff_url string, diff string")
    got = I.attach_diff(prs, diffs, hot_rows=10)
    want = [(i, u, {"hot": "B", "u6": "D6"}.get(u, "")) for i, u in rows(prs)]
    assert sorted(rows(got), key=str) == sorted(want, key=str)
    assert sorted(rows(I.attach_diff(prs, diffs)), key=str) == sorted(want, key=str)
    assert rows(I.attach_diff(prs.limit(0), diffs)) == []
    assert {r[2] for r in rows(I.attach_diff(prs, diffs.limit(0)))} == {""}


def test_attach_diff_exchanges_texts_once(spark, tmp_path):
    spark.createDataFrame([(1, "u")], "delivery_id long, diff_url string").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([("u", "D")], "diff_url string, diff string").write.parquet(f"{tmp_path}/d")
    j = I.attach_diff(spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/d"))
    plan = j._jdf.queryExecution().executedPlan().toString()
    lines = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln]
    assert sum("__url" in ln for ln in lines) == 1 and sum("diff_url" in ln for ln in lines) == 1 and "SortMergeJoin" in plan


def test_audit_drops_diffs(spark):
    df = spark.createDataFrame([(1, "raw", "san", "ok")], "pr_id long, raw_diff string, sanitized_diff string, s string")
    assert I.audit_rows(df).columns == ["pr_id", "s"]


def test_reason_prints_values_like_python(spark):
    bodies = ['{"action":true}', '{"action":5}', '{"action":null}']
    df = spark.createDataFrame([(i, b, sig(b)) for i, b in enumerate(bodies)],
                               "delivery_id long, raw_body string, signature_header string")
    got = [r[0] for r in I.route_deliveries(df, KEY).orderBy("delivery_id").select("reason").collect()]
    assert got == ["Action 'True' not processed", "Action '5' not processed", "Action 'None' not processed"]
