"""Every fleet query against its SQL on the smallest tables, and the contract of the entry module."""

from __future__ import annotations

import datetime
import decimal
import os
from collections import Counter

import duckdb
import pytest

from roadlark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 9) + 0.0)
    return v.isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    theirs = Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    ours = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert ours == theirs


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_top_reasons_with_equal_sums_and_without_types(spark, tmp_path):
    rows = [(1, "view", 0.1), (1, "view", 0.2), (1, "click", 0.3), (1, "error", 9.0), (2, "view", 0.7), (2, "view", 0.1), (2, "error", 0.8), (2, "click", 0.5), (2, "login", 0.5), (3, None, 2.0), (3, "view", 1.0), (4, None, 1.0), (5, None, 1.0), (5, "view", 1.0), (6, "view", 0.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: (r.reasons, r.sentence) for r in catalogue.QUERIES["top_reasons"](spark, str(tmp_path)).collect()}
    assert got == {1: ("error,click,view", "Most points: error"), 2: ("error,view,click", "Most points: error"), 3: ("view", None), 4: (None, None), 5: ("view", "Most points: view")}
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet' where user_id > 2")
    assert {r[0]: r[1:] for r in con.sql(catalogue.SQL["top_reasons"]).fetchall()} == {k: v for k, v in got.items() if k > 2}


def test_decile_percentile_with_equal_sums(spark, tmp_path):
    rows = [(k, x) for k, xs in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1)), (3, (0.2, 0.3, 0.1)), (4, (0.1, 0.1, 0.1))) for x in xs]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = {r.o_custkey: r.pct for r in catalogue.QUERIES["decile_percentile"](spark, str(tmp_path)).collect()}
    assert got == {1: 0.75, 2: 0.75, 3: 0.75, 4: 0.25}


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
