"""Registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as registered
from tools.check_sql import TABLES, rows_of

CHECKS = registered.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_entry(spark):
    frame = registered.entry(spark)
    assert frame.count() == 6
    assert frame.columns == ["category", "total_quantity", "total_amount", "total_profit", "profit_ratio"]


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, sf, db, name):
    frame = registered.queries()[name](spark, sf)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert ours[1]
    if name in CHECKS:
        relation = db.sql(CHECKS[name])
        assert ours == rows_of(relation.columns, relation.fetchall())
