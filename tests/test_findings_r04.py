"""Equity over fills that are dealt once: what is shuffled and written, and ends of markets that go along with their fills."""

import datetime
import random
import shutil
from decimal import Decimal

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_catalogue import norm

from tidebook import catalogue, tables
from tidebook.operators import accounts
from tidebook.plans import accounts as plans

SF = "/root/testdata/sf0.001"
START = datetime.datetime(2024, 1, 1)
FILLS = "market long, place long, signed_qty decimal(24,6), price decimal(12,6), fee decimal(12,6)"


def write(folder, fills):
    """The smallest tables with these fills (order, part, supplier, quantity, discount, flag, days)."""
    for t in tables.TABLES:
        if t != "lineitem":
            shutil.copy(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    schema = pq.read_schema(f"{SF}/lineitem.parquet")
    rows = [dict(l_orderkey=o, l_partkey=p, l_suppkey=s, l_linenumber=1, l_quantity=q, l_extendedprice=1.0, l_discount=c, l_tax=0.0, l_returnflag=flag, l_linestatus="O", l_shipdate=START + datetime.timedelta(days=days)) for o, p, s, q, c, flag, days in fills]
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), f"{folder}/lineitem.parquet")
    return str(folder)


def both(spark, folder, name):
    """(rows, rows by the SQL) of a query, as sorted tuples by column name."""
    df, db = catalogue.queries()[name](spark, folder), duckdb.connect()
    for t in tables.TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cursor, cols = db.execute(catalogue.oracle_sql()[name]), sorted(df.columns)
    have = [c[0] for c in cursor.description]
    want = sorted((tuple(norm(r[have.index(c)]) for c in cols) for r in cursor.fetchall()), key=repr)
    return sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr), want


@pytest.mark.parametrize("name", ["equity_grid", "portfolio_summary"])
def test_no_table_of_fills_is_written(spark, monkeypatch, name):
    sizes, write_out = [], plans.stage_table
    monkeypatch.setattr(plans, "stage_table", lambda df, label: sizes.append(df.count()) or write_out(df, label))
    catalogue.queries()[name](spark, SF).collect()
    assert max(sizes, default=0) < 100 < spark.read.parquet(f"{SF}/lineitem.parquet").count()


@pytest.mark.parametrize("order", [None, ["place"]])
def test_fills_are_dealt_once(spark, order):
    fills = spark.createDataFrame([], FILLS)
    rows = accounts.positions(fills) if order is None else accounts.positions(fills.withColumnRenamed("place", "_n"), order=["_n"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1


def test_the_account_shuffles_fills_once(spark):
    plan = plans._cells(spark, SF)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and plan.count("Exchange hashpartitioning(at_ms") == 1


@pytest.mark.parametrize("name", ["equity_grid", "portfolio_summary", "position_states", "position_fold", "settlement"])
def test_ends_of_markets_stand_behind_their_fills(spark, tmp_path, name):
    rng = random.Random(4)
    # parts of all residues of the market's rules; some have no fill, some only one, some several in an instant, some are not defined
    fills = [(i, rng.choice((*range(1, 60), 10**6 + 1)), rng.randrange(1, 99), float(rng.randrange(1, 9)), rng.randrange(9) / 100, rng.choice("ARNR"), rng.randrange(40) * 13) for i in range(300)]
    fills += [(i, 77, 5 + i, 3.0, 0.01, "AR"[i % 2], 100) for i in range(400, 404)]
    got, want = both(spark, write(tmp_path, fills), name)
    assert want and got == want


def test_columns_beside_and_numbers_of_fills(spark):
    d = lambda x: Decimal(str(x))
    rows = [(1, 9, d(2), d(0.5), None), (1, 4, d(-3), d(0.4), d(0.1)), (2, 7, d(1), d(0.2), d(0)), (1, 5, d(1), d(0.6), d(0))]
    fills = spark.createDataFrame(rows, FILLS).withColumnRenamed("place", "_at")
    out = accounts.positions(fills, order=["_at"], beside={"next": F.lead("_at").over(accounts.in_order(["_at"]))})
    assert "_at" not in out.columns
    got = [(r.market, r.place, r.next, r.qty, r.closed, r.realised_so_far, r.unknown_so_far) for r in out.orderBy("market", "place").collect()]
    assert got == [(1, 1, 5, -3, 0, 0, 0), (1, 2, 9, -2, 1, d("-0.2"), 0), (1, 3, None, 0, 2, d("-0.4"), 1), (2, 1, None, 1, 0, 0, 0)]


def test_rows_out_of_order_are_not_folded(spark):
    d = Decimal
    rows = spark.createDataFrame([(1, 2, d(1), d("0.5"), d(0)), (1, 1, d(-1), d("0.4"), d(0))], FILLS).coalesce(1)
    with pytest.raises(Exception, match="out of order"):
        accounts._folded(rows, ["market"], "signed_qty").collect()
