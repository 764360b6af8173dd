"""Spark vs DuckDB on the smallest scale factor for a cross-section of the queries
(the full set runs in tools/check_oracle.py)."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from reviewlake.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
NAMES = ["sanitized_mask_counts", "delivery_routing", "report_validation", "vetoed_findings", "reports"]


def digest(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda v: "NULL" if v is None else (repr(round(v, 9)) if isinstance(v, float) else str(v))
    return hashlib.sha256("\x1e".join(sorted("\x1f".join(norm(r[i]) for i in order) for r in data)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    res = duck.execute(entry_mod.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want) and len(got) > 0
    assert digest(df.columns, got) == digest(cols, want)
