from decimal import Decimal

import pytest

from tidebook.operators import book, execution, folds, replay, temporal
from tidebook.sources import lake


def test_asof_keeps_a_stated_null_and_is_inclusive(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (1, 20), (2, 5)], "k int, t long")
    right = spark.createDataFrame([(1, 5, "a"), (1, 15, None)], "k int, t long, v string")
    got = {(r.k, r.t): r.v for r in temporal.asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {(1, 5): "a", (1, 10): "a", (1, 20): None, (2, 5): None}


def test_grid_and_change_points(spark):
    spans = spark.createDataFrame([(1, 9, 31), (2, 11, 12)], "k int, a long, b long")
    assert sorted((r.k, r.bucket_ms) for r in temporal.grid(spans, "a", "b", 10).collect()) == [(1, 10), (1, 20), (1, 30)]
    series = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, None), (1, 4, None), (1, 5, 5)], "k int, t int, v int")
    assert [r.t for r in temporal.change_points(series, ["k"], ["t"], "v").orderBy("t").collect()] == [1, 3, 5]


FRAMES = [(5, False, "first"), (6, False, "ok"), (6, False, "duplicate"), (4, False, "out_of_order"), (7, False, "ok"), (9, False, "gap"), (8, False, "degraded"), (None, False, "unsequenced"), (10, False, "degraded"),
          (12, True, "recovered"), (13, False, "ok"), (12, False, "out_of_order"), (15, False, "gap"), (None, True, "recovered"), (30, False, "first")]


def test_sequence_verdicts(spark):
    rows = [(1, i, s, r) for i, (s, r, _) in enumerate(FRAMES)]
    got = [r.verdict for r in folds.sequence_verdicts(spark.createDataFrame(rows, "stream int, ordinal int, seq int, recovery boolean")).orderBy("ordinal").collect()]
    assert got == [v for *_, v in FRAMES]


def test_ladder_hash_sorts_members_not_lines(spark):
    import hashlib

    rows = [(1, 1, "a"), (1, 10, "b"), (1, 2, None)]
    got = book.ladder_hash(spark.createDataFrame(rows, "g int, m long, hash string"), ["g"], "m").first()
    assert got.hash == hashlib.sha256(b"1=a\n10=b\n2=null").hexdigest() and got.members == 3


def test_throttle_counts_from_the_last_report(spark):
    rows = [(1, t) for t in (0, 5, 10, 14, 20, 31)] + [(2, 7)]
    got = sorted((r.k, r.t) for r in replay.throttled(spark.createDataFrame(rows, "k long, t long"), "k", "t", 10).collect())
    assert got == [(1, 0), (1, 10), (1, 20), (1, 31), (2, 7)]


def test_execution_priority_queue_and_cancel(spark):
    import tidebook
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(tidebook)
    orders = spark.createDataFrame([(1, 1, 0, "bid", 0.4, 5.0, 3.0, None), (1, 2, 0, "bid", 0.5, 5.0, 0.0, None), (1, 3, 0, "bid", 0.5, 5.0, 0.0, 100)],
                                   "market long, order_id long, ms long, side string, price double, qty double, ahead double, cancel_at long")
    trades = spark.createDataFrame([(1, 10, 50, "bid", 0.4, 9.0), (1, 11, 150, "bid", 0.4, 12.0), (1, 12, 250, "bid", 0.4, 9.0)],
                                   "market long, trade_id long, ms long, hits string, price double, size double")
    got = sorted((r.model, r.trade_id, r.order_id, r.qty) for r in execution.simulate(orders, trades).collect())
    assert got == [("conservative", 11, 2, 5.0), ("conservative", 11, 3, 5.0), ("conservative", 12, 1, 5.0),
                   ("touch", 11, 1, 2.0), ("touch", 11, 2, 5.0), ("touch", 11, 3, 5.0), ("touch", 12, 1, 3.0)]


def test_lake_writes_check_themselves(spark, tmp_path):
    kind = lake.schema("trades")
    df = spark.createDataFrame([("a", "2026-01-01", "S", 1), ("b", "2026-01-01", None, 2)], "trade_id string, date string, series string, received_at_ms long")
    path = str(tmp_path / "trades")
    assert lake.write_partitioned(df, path, kind) == 2
    more = df.unionByName(df.where("series = 'S'"))
    assert lake.write_partitioned(more, path, kind) == 3
    with pytest.raises(ValueError, match="shrink"):
        lake.write_partitioned(df, path, kind)
    assert lake.write_partitioned(df, path, kind, allow_shrink=True) == 2
    assert lake.contract(spark.createDataFrame([("1",)], "ingest_ordinal string"), lake.schema("deltas")) == ["ingest_ordinal: string is not bigint"]
    assert lake.run_key({"a": 1, "b": 2}) == lake.run_key({"b": 2, "a": 1})


def test_archive_round_trip(spark, tmp_path):
    frames = spark.createDataFrame([("t", 1, "x"), ("t", 2, "y")], "channel string, hour int, payload string")
    lake.archive(frames, str(tmp_path / "raw"))
    back = lake.restore(spark, str(tmp_path / "raw"), frames.schema, 2)
    assert sorted(r.payload for r in back.collect()) == ["x", "y"]
    with pytest.raises(ValueError, match="manifest"):
        lake.restore(spark, str(tmp_path / "raw"), frames.schema, 3)
