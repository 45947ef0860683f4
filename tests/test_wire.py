"""Frames, histories, invariants and queue audits on hand-made rows."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidebook.functions import scalar
from tidebook.operators import history, invariants, placement, queue_audit
from tidebook.sources import frames, lake, silver

D = Decimal

FRAMES = [
    ('{"type":"orderbook_delta","sid":3,"seq":9,"msg":{"market_ticker":"M","price_dollars":"0.4","delta_fp":"-1.5","side":"yes","ts_ms":77,"more":1}}', "delta", None),
    ('{"type":"orderbook_delta","msg":{"market_ticker":"M","price_dollars":0.4,"delta_fp":2,"side":"no"}}', "delta", None),  # numbers for texts
    ('{"type":"orderbook_delta","msg":{"market_ticker":"M","price_dollars":"0.4000005","delta_fp":"1.0000015","side":"no"}}', "delta", None),
    ('{"type":"orderbook_delta","msg":{"market_ticker":"M","price_dollars":"1e-1","delta_fp":"1","side":"no"}}', None, "schema: price_dollars"),
    ('{"type":"orderbook_delta","msg":{"market_ticker":"M","price_dollars":"0.1","side":"no"}}', None, "schema: delta_fp"),
    ('{"type":"orderbook_delta","msg":{"market_ticker":"M","price_dollars":"0.1","delta_fp":"1","side":"both"}}', None, "schema: side"),
    ('{"type":"orderbook_delta","msg":{"price_dollars":"0.1","delta_fp":"1","side":"no"}}', None, "schema: market_ticker"),
    ('{"type":"orderbook_snapshot","msg":{"market_ticker":"M","yes_dollars_fp":[["0.40","3"],["0.41","2.5"]],"no_dollars_fp":null}}', "snapshot", None),
    ('{"type":"orderbook_snapshot","msg":{"market_ticker":"M"}}', "snapshot", None),
    ('{"type":"orderbook_snapshot","msg":{"market_ticker":"M","yes_dollars_fp":[["0.40"]]}}', None, "schema: yes_dollars_fp"),
    ('{"type":"orderbook_snapshot","msg":{"market_ticker":"M","no_dollars_fp":"none"}}', None, "schema: no_dollars_fp"),
    ('{"type":"trade","msg":{"market_ticker":"M","trade_id":"t","yes_price_dollars":"0.6","no_price_dollars":"0.4","count_fp":"7","taker_side":"no","is_block_trade":true}}', "trade", None),
    ('{"type":"trade","msg":{"market_ticker":"M","trade_id":"t","yes_price_dollars":"0.6","no_price_dollars":"0.4","count_fp":"7","taker_book_side":"up"}}', None, "schema: taker_book_side"),
    ('{"type":"trade","msg":{"market_ticker":"M","yes_price_dollars":"0.6","no_price_dollars":"0.4","count_fp":"7"}}', None, "schema: trade_id"),
    ('{"type":"ticker","msg":{}}', "raw", None), ("{}", None, "no type"), ("[1]", None, "no type"), ('{"type":', None, "not json"), ("", None, "not json"), (None, None, "not json"),
]


def test_every_frame_is_an_event_raw_or_quarantined(spark):
    table = spark.createDataFrame([(i, 5, t) for i, (t, _, _) in enumerate(FRAMES)], "ordinal long, receive_ms long, text string")
    rows = frames.parsed(table)
    got = {r.ordinal: r for r in rows.collect()}
    assert [(got[i].kind, got[i].reason) for i in range(len(FRAMES))] == [(k, r) for _, k, r in FRAMES]
    assert (got[0].sid, got[0].seq, got[0].exchange_ms, got[0].price, got[0].delta) == (3, 9, 77, D("0.4"), D("-1.5"))
    assert (got[1].price, got[1].delta, got[2].price, got[2].delta) == (D("0.4"), 2, D("0.400000"), D("1.000002"))  # half to even
    assert got[5].price is None and got[11].is_block and (got[11].taker_side, got[11]["count"]) == ("no", 7)
    levels, deltas, trades, bad = frames.split(rows)
    assert sorted((r.ordinal, r.side, r.price, r["size"]) for r in levels.where("side IS NOT NULL").collect()) == [(7, "yes", D("0.4"), 3), (7, "yes", D("0.41"), D("2.5"))]
    assert levels.where("side IS NULL").select("ordinal").first()[0] == 8
    assert (deltas.count(), trades.count(), bad.count(), rows.where("kind = 'raw'").count()) == (3, 1, 13, 1)


def test_gates(spark):
    rows = [(v, k, None) for v in ("ok", "gap", "duplicate", "out_of_order", "degraded", "recovered", "unsequenced") for k in ("delta", "snapshot", None)]
    got = frames.gated(spark.createDataFrame(rows, "verdict string, kind string, reason string")).where("applies").collect()
    assert {(r.verdict, r.kind) for r in got} == {(v, k) for v in ("ok", "recovered", "unsequenced") for k in ("delta", "snapshot")} | {("degraded", "snapshot")}


def test_intervals_merge_equal_neighbours_and_any_day_equals_the_fold(spark):
    rows = [(1, 10, 1, "a", None), (1, 20, 2, "a", None), (1, 30, 3, "b", None), (1, 30, 4, "b", "yes"), (1, 40, 5, "a", "yes"), (1, 50, 6, "a", "yes"), (2, 15, 7, None, None), (2, 25, 8, None, None)]
    table = spark.createDataFrame(rows, "market long, t long, v long, status string, result string")
    held = history.intervals(table, ["market"], "t", "v", ["status", "result"])
    assert sorted(map(tuple, held.collect()), key=str) == sorted([(1, "a", None, 10, 30, 2), (1, "b", "yes", 30, 40, 2), (1, "a", "yes", 40, None, 2), (2, None, None, 15, None, 2)], key=str)
    days = [5, 10, 19, 30, 45, 99]
    got = {(r.market, r.day): (r.status, r.result) for r in history.state_at(held, days, "day").collect()}
    want = {(m, t): rows[i][3:] for m in (1, 2) for t in days for i in range(len(rows)) if rows[i][0] == m and rows[i][1] <= t}  # the last one stays
    assert got == want
    seen = {(r.market, r.result): r.first_ms for r in history.first_seen(table, ["market"], "t", "result").collect()}
    assert seen == {(1, "yes"): 30}


def test_a_dated_export_can_run_again_and_does_not_shrink(spark, tmp_path):
    versions = spark.createDataFrame([(1, 0, 1, "active", ""), (1, 86_400_000, 2, "closed", "yes"), (2, 5, 3, "active", None)], "market long, observed_ms long, version long, status string, result string")
    markets = spark.createDataFrame([(1, "S", "flat", D(1))], "market long, series string, fee_type string, fee_multiplier decimal(4,2)")
    root = str(tmp_path / "lake")
    for day in ("1970-01-01", "1970-01-02", "1970-01-01"):
        state, past = silver.market_state(versions, markets, day)
        assert silver.export({"market_state": state, "market_state_history": past}, root, ("date", "series"))["market_state"] == 2
    got = {(str(r.date), r.market): (r.series, r.status, r.result_first_observed_ms) for r in spark.read.parquet(f"{root}/market_state").collect()}
    assert got == {("1970-01-01", 1): ("S", "active", None), ("1970-01-02", 1): ("S", "closed", 86_400_000), ("1970-01-01", 2): ("unknown", "active", None), ("1970-01-02", 2): ("unknown", "active", None)}
    assert spark.read.parquet(f"{root}/market_state_history").count() == 5
    more, _ = silver.market_state(versions.unionByName(versions.withColumn("market", F.lit(7))), markets, "1970-01-02")
    lake.write_partitioned(more, f"{root}/market_state", silver.schema("market_state"))
    with pytest.raises(ValueError, match="would shrink"):
        silver.export({"market_state": silver.market_state(versions, markets, "1970-01-02")[0]}, root, ("date", "series"))


def _recording(spark, **changed):
    given = {
        "frames": ([("s", 1), ("s", 2), ("t", 2), ("t", 3), ("t", None)], "session string, ordinal long"),
        "gaps": ([(1, "recovered")], "gap_id long, status string"),
        "events": ([("sequence_gap", "warning"), ("crossed_book", "info")], "type string, severity string"),
        "deltas": ([(1, 5, 10, True, D(0), D(2), D(2)), (1, 5, 9, False, D(0), D(-1), D(-1))], "stream long, market long, place long, applied boolean, pre decimal(24,6), post decimal(24,6), delta decimal(24,6)"),
        "snapshots": ([(1, 5, 10, "ws_initial", None), (1, 5, 12, "local_materialized", "h")], "stream long, market long, place long, source string, hash string"),
        "streams": ([(1, "s", "book", True), (2, "s", "book", False), (3, "t", "book", False)], "stream long, session string, channel string, ended boolean"),
        "sessions": ([("s", "sigterm"), ("t", "deploy")], "session string, end_reason string"),
        "replays": ([(5, 3, 3), (6, 0, 0)], "market long, checked long, matched long"),
    }
    return invariants.Recording(**{k: spark.createDataFrame(changed.get(k, rows), schema) for k, (rows, schema) in given.items()})


def test_each_invariant_holds_and_each_breaks(spark):
    good = {r.name: r["pass"] for r in invariants.soak(_recording(spark)).collect()}
    assert len(good) == 8 and all(good.values())
    faults = {
        "frames durable": {"frames": [("s", 1), ("s", 3)]}, "gaps recovered": {"gaps": [(1, "open")]}, "deltas seeded": {"snapshots": [(1, 5, 11, "ws_initial", None), (2, 5, 1, "ws_initial", None), (1, 5, 1, "local_materialized", "h")]},
        "no duplicate subscriptions": {"streams": [(1, "s", "book", False), (2, "s", "book", False)]}, "arithmetic": {"deltas": [(1, 5, 10, True, D(0), D(3), D(2))]}, "snapshots valid": {"snapshots": [(1, 5, 1, "ws_initial", None), (1, 5, 12, "local_materialized", None)]},
        "sessions closed": {"sessions": [("s", "sigterm"), ("t", None)]}, "replay equal": {"replays": [(5, 3, 2)]},
    }
    for name, changed in faults.items():
        assert [r.name for r in invariants.soak(_recording(spark, **changed)).where("NOT pass").collect()] == [name]
    late = _recording(spark, frames=[("s", 3), ("s", 4)], gaps=[])  # a session that begins late; no gap that could have been recovered
    assert {r.name for r in invariants.soak(late).where("NOT pass").collect()} == {"frames durable", "gaps recovered"}


def test_deploy_gates(spark):
    sessions = lambda *rows: spark.createDataFrame(list(rows), "session string, started long, end_reason string, commit string, flushed boolean")
    gaps = lambda *rows: spark.createDataFrame(list(rows), "started long, ended long")
    two = (("x", 1, "crash", None, False), ("s", 10, "sigterm", None, True), ("t", 20, None, "abc", None))
    good = {r.name: r["pass"] for r in invariants.deploy(_recording(spark), sessions(*two), gaps((15, 19))).collect()}
    assert len(good) == 6 and all(good.values())
    bad = {r.name: r["pass"] for r in invariants.deploy(_recording(spark, deltas=[(3, 5, 1, True, D(0), D(1), D(1))]), sessions(*two[:2], ("t", 20, None, None, None)), gaps((5, 30))).collect()}
    assert {n for n, ok in bad.items() if not ok} == {"build recorded", "restart from fresh snapshots", "deploy recorded as a gap"}
    one = {r.name: r["pass"] for r in invariants.deploy(_recording(spark), sessions(two[1]), gaps()).collect()}
    assert {n for n, ok in one.items() if ok} == {"restart from fresh snapshots"}


def test_catalogue_of_integrity_events(spark):
    assert (len(invariants.TYPES), len(set(invariants.TYPES)), len(invariants.SEVERITIES)) == (16, 16, 4) and set(invariants.SILENT) < set(invariants.TYPES)
    rows = [("sequence_gap", "info"), ("sequence_gap", "fatal"), ("odd", "info"), (None, "info"), ("crossed_book", None)]
    table = spark.createDataFrame(rows, "type string, severity string")
    assert sorted(map(str, (r.type for r in invariants.unlisted(table).collect()))) == ["None", "crossed_book", "odd", "sequence_gap"]
    assert [r[0] for r in table.select(invariants.severity_rank(F.col("severity"))).collect()] == [0, None, 0, 0, None]


def test_queue_audit_by_hand(spark):
    """One probe at 0.40 behind a better level: reported at the own level's size, 100 ms late."""
    spans = spark.createDataFrame([(1, "yes", D("0.40"), D(10), 0, 1000), (1, "yes", D("0.40"), D(6), 1000, None), (1, "yes", D("0.41"), D(5), 0, 500), (1, "no", D("0.55"), D(9), 0, None)], "market long, side string, price decimal(12,6), size decimal(24,6), from_ms long, to_ms long")
    polls = spark.createDataFrame([(7, 1, "yes", D("0.40"), k, t, q) for k, t, q in ((0, 400, D(10)), (1, 600, D(10)), (2, 900, None), (3, 1100, D(6)), (4, 1050, D(6)))], "probe_id long, market long, side string, price decimal(12,6), seq_no int, at_ms long, queue decimal(24,6)")
    tops = spark.createDataFrame([(1, "yes", 0, D("0.41")), (1, "yes", 500, D("0.40"))], "market long, side string, ms long, best decimal(12,6)")
    trades = spark.createDataFrame([(1, "yes", D("0.41"), 450, D(2)), (1, "yes", D("0.39"), 450, D(50)), (1, "yes", D("0.40"), 1000, D(4))], "market long, side string, price decimal(12,6), ms long, size decimal(24,6)")
    rows = queue_audit.transitions(polls, spans, tops, trades, 100, 1, (0, 100))
    got = {r.seq_no: r for r in rows.collect()}
    assert {k: (r.moved, r.fell_same, r.fell_better, r.executed, r.ticks, r.h0_level, r.h1_level, r["class"]) for k, r in got.items()} == {
        1: (0, 0, 5, 2, 1, 10, 10, "STILL_UNEXPLAINED"), 3: (4, 4, 0, 4, 0, 6, 6, "TRADE_EXPLAINED"), 4: (0, 0, 0, 0, 0, 10, 10, "SAME_LEVEL_EXPLAINED"),
    }
    assert (got[1].best_lag, got[1].residual, got[3].best_lag) == (0, 5, 0)
    both = {r.hypothesis: r for r in queue_audit.compared(rows).collect()}
    assert (both["H0_same_price"].observations, both["H0_same_price"].moves, both["H0_same_price"].explained_rate) == (3, 1, 1.0)
    assert {r.regime: r.transitions for r in queue_audit.by_regime(rows).collect()} == {"AT_TOUCH": 2, "1_TICK_BEHIND": 1}
    assert queue_audit.transitions(polls.limit(0), spans, tops, trades, 100, 1, (0,)).count() == 0


def test_series_selectors(spark):
    rows = spark.createDataFrame([("KXA1", "x"), ("KXA2", "y"), ("KXB", "x"), ("Z", None), (None, "x")], "s string, c string")
    pick = lambda **of: {r.s for r in rows.where(scalar.series_chosen(F.col("s"), F.col("c"), **of)).collect()}
    assert pick(prefixes=("KXA",)) == {"KXA1", "KXA2"} and pick(prefixes=("KXA", "KXB"), categories=("x",)) == {"KXA1", "KXB"}
    assert pick(prefixes=("KXA",), allow=("Z", "KXB", "none"), deny=("KXB",)) == {"Z"} and pick() == set()


def test_probes_keep_the_design_level(spark):
    """Against one pick after the other: the least sampled cell that has an option left, never the same option twice, no cell past its quota."""
    books = [(m, m % 3, D(40 - m % 5) / 100, D(45 + m % 7) / 100) for m in range(40)] + [(90, 0, None, D("0.5")), (91, 0, D("0.01"), D("0.99")), (92, 1, D("0.5"), D("0.4"))]
    tops = spark.createDataFrame(books, "market long, series long, bid decimal(12,6), ask decimal(12,6)")
    levels = spark.createDataFrame([(m, side, p / 100, D(m % 4)) for m, *_ in books for side in ("yes", "no") for p in map(D, range(1, 100))], "market long, side string, price decimal(12,6), size decimal(24,6)")
    found = placement.options(tops, levels, (1, 2))
    rows = {(r.market, r.series, r.side, r.ticks): r.price for r in found.collect()}
    want = {(m, s, side, k): (b - D(k) / 100 if side == "bid" else a + D(k) / 100) for m, s, b, a in books if b and m % 4 for side in ("bid", "ask") for k in (1, 2)}
    assert rows == {key: p for key, p in want.items() if 0 < p < 1 and key[0] not in (91, 92)}
    assert placement.options(tops, levels, (1,), resting=False).count() > found.where("ticks = 1").count()
    sampled = {(0, "bid", 1): 3, (1, "ask", 2): 1, (2, "bid", 2): 50}
    table = spark.createDataFrame([(*k, n) for k, n in sampled.items()], "series long, side string, ticks int, n long")
    got = placement.chosen(found, table, 45, "s", 6).orderBy("place").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in placement.chosen(found.repartition(7), table, 45, "s", 6).orderBy("place").collect()]
    count, left = dict(sampled), set(rows)
    for r in got:
        cell = (r.series, r.side, r.ticks)
        open_cells = {k[1:] for k in left if count.get(k[1:], 0) < 6}
        assert cell in open_cells and count.get(cell, 0) == min(count.get(c, 0) for c in open_cells) == r.level
        left.remove((r.market, *cell))
        count[cell] = count.get(cell, 0) + 1
    assert len(got) == 45 and [tuple(r) for r in placement.chosen(found, table, 45, "t", 6).orderBy("place").collect()] != [tuple(r) for r in got]
    assert placement.chosen(found, table, 9999, "s").count() == len(rows) and placement.chosen(found.limit(0), table, 5, "s").count() == 0
