"""Every catalogue query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from quillon import queries as catalogue
from quillon.catalog import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    flat = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(flat(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_matches_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_casts_and_except_reach_whole_tables(spark):
    """The cast covers every order, and EXCEPT takes away customers by their balance, of any id."""
    found, data = catalogue.queries(), DATA.replace("0.001", "0.01")
    orders, customer = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("orders", "customer"))
    assert found["cast_floor_all"](spark, data).count() == orders.count() > 200
    kept = {r.k for r in found["except_balance"](spark, data).collect()}
    out = {r.o_custkey for r in orders.collect()} - kept
    assert max(out) >= 500 and min(kept) < 500 and out <= {r.c_custkey for r in customer.where("c_acctbal < 0").collect()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
