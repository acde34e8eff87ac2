import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import queries as engine


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: v.isoformat() if isinstance(v, datetime.datetime) else repr(v)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, sf, db, name):
    df = engine.QUERIES[name](spark, sf)
    got = plain(df.collect(), df.columns)
    if name in engine.ORACLES:
        cur = db.execute(engine.ORACLES[name])
        assert got == plain(cur.fetchall(), [c[0] for c in cur.description])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_is_pushed_down(spark, sf):
    from pyspark.sql import functions as F

    plan = spark.read.parquet(f"{sf}/orders.parquet").where(F.col("o_totalprice") >= 1e5).select("o_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThanOrEqual(o_totalprice" in plan


def test_summaries_of_odd_texts(spark, tmp_path):
    odd = ["", " ", "\u00a0a. b.\u3000", "a. b.\x0b", "a.\x0bb. c. d", "a.\x01b. c", "a. \x01b. c", " \ta.\n b.\n", "a.\u2003b. c. d", "x" * 400, "e\u0301" * 201, None]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["summary"] for r in engine.QUERIES["f14_summary"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(engine.ORACLES["f14_summary"]).fetchall())
