"""Queries on small hand-made event tables, against their SQL: empty levels that come first, replays past a divergence, ids far apart."""

import datetime
import random
import shutil

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_catalogue import norm

from tidebook import catalogue, tables
from tidebook.operators import accounts

SF = "/root/testdata/sf0.001"
START = datetime.datetime(2024, 1, 1)


def write(folder, events):
    """The smallest tables with these events (event_id, hours, user_id, event_type, value)."""
    for t in tables.TABLES:
        if t != "events":
            shutil.copy(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    schema = pq.read_schema(f"{SF}/events.parquet")
    rows = [dict(event_id=i, ts=START + datetime.timedelta(hours=h), user_id=u, event_type=kind, value=v, props='{"k": 1}') for i, h, u, kind, v in events]
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), f"{folder}/events.parquet")
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


#: Market 1 begins with a delta of nothing: no level has been displayed when its probe enters.
EMPTY_FIRST = [(10, 0, 1, "view", 0.0), (12, 5, 1, "click", 7.0), (20, 9, 1, "view", 3.0), (15, 1, 2, "view", 4.0), (25, 7, 2, "view", 2.5)]


@pytest.mark.parametrize("name", ["depth_ahead", "entry_identity"])
def test_a_market_may_begin_with_an_empty_level(spark, tmp_path, name):
    got, want = both(spark, write(tmp_path, EMPTY_FIRST), name)
    assert got == want


def test_warnings_of_a_replay_go_on_past_a_divergence(spark, tmp_path):
    rng = random.Random(1)
    kinds = ("view", "click", "view", "signup", "purchase") * 2 + ("error",)
    # ids that fall on one level of each market, so that stored snapshots of a part of its size are soon overdrawn
    events = [(90 * i + 3, i * 0.4, i % 3, rng.choice(kinds), float(rng.randrange(1, 5))) for i in range(600)]
    got, want = both(spark, write(tmp_path, events), "replay_warnings")
    assert {"diverged", "not applied"} <= {w for row in want for w in row} and got == want


def test_hashes_are_verified_where_ids_lie_far_apart(spark, tmp_path):
    rng = random.Random(5)
    events = [(i * 10**11 + i % 7, i * 0.4, i % 3, rng.choice(("view", "click", "signup", "error")), float(rng.randrange(1, 9))) for i in range(120)]
    got, want = both(spark, write(tmp_path, events), "replay_verify")
    assert len(want) == 3 and got == want


def test_positions_pass_their_columns_through_the_fold(spark):
    fills = spark.createDataFrame([], "market long, place long, signed_qty decimal(24,6), price decimal(12,6), fee decimal(12,6)")
    assert "Join" not in accounts.positions(fills)._jdf.queryExecution().toString()
