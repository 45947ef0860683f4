"""The event loop on hand-built books."""

import pytest

from tidebook.operators import backtest
from tidebook.operators.backtest import ONE, Exchange

P = lambda x: round(x * ONE)


def exchange(strategy="join_best", model="conservative", latency=100, on_gap="cancel_all", **more):
    args = {"size": 10 * ONE, "cap": 50 * ONE, "min_spread": P(0.01), "reprice": P(0.01)} | more
    return Exchange(backtest.STRATEGIES[strategy](), backtest.MODELS[model](), latency, 100, on_gap, **args)


def opened(x):
    x.step(0, "delta", "yes", P(0.40), 100 * ONE)
    x.step(0, "delta", "no", P(0.55), 100 * ONE)
    return x


def said(x, *states):
    return [(o, ms, state, side, price / ONE, qty / ONE) for o, _, ms, state, side, price, qty, *_ in x.out if not states or state in states]


def test_quotes_join_and_wait_for_their_queue():
    x = opened(exchange())
    x.step(50, "trade", "no", P(0.40), 200 * ONE)  # before the order rests
    x.step(150, "trade", "no", P(0.40), 104 * ONE)  # 100 ahead, then 4
    x.step(160, "trade", "no", P(0.39), 3 * ONE)  # through the price
    assert said(x, "submitted") == [(1, 0, "submitted", "bid", 0.4, 10), (2, 0, "submitted", "ask", 0.45, 10)]
    assert said(x, "filled") == [(1, 150, "filled", "bid", 0.4, 4), (1, 160, "filled", "bid", 0.4, 3)] and x.position == 7 * ONE


@pytest.mark.parametrize(("model", "filled"), [("touch", 10), ("conservative", 0), ("decay", 5)])
def test_fill_models(model, filled):
    x = opened(exchange(model=model))
    x.step(200, "delta", "yes", P(0.40), -60 * ONE)  # decay: half of it was ahead
    x.step(300, "trade", "no", P(0.40), 75 * ONE)
    assert sum(q for *_, q in said(x, "filled")) == filled


def test_ties_go_against_the_strategy():
    x = opened(exchange(model="touch"))
    x.step(100, "trade", "no", P(0.40), 5 * ONE)  # at the instant of the activation: too early
    x.step(101, "trade", "no", P(0.40), 5 * ONE)
    assert [r[1] for r in said(x, "filled")] == [101]


def test_crossing_sweeps_and_ioc_cancels_the_rest():
    x = opened(exchange(min_spread=ONE))  # quotes nothing by itself
    x.step(1, "delta", "no", P(0.50), 5 * ONE)  # asks: 0.45 x 100, 0.50 x 5
    x.submit(1, "bid", P(0.50), 120 * ONE, ioc=True)
    x.step(200, "delta", "yes", P(0.10), ONE)
    assert said(x, "filled", "cancelled") == [(1, 101, "filled", "bid", 0.45, 100), (1, 101, "filled", "bid", 0.5, 5), (1, 101, "cancelled", "bid", 0.5, 15)]


def test_rejects_cancels_in_flight_and_invalid_books():
    x = opened(exchange(min_spread=ONE))
    x.submit(0, "bid", 0, ONE)
    x.submit(0, "bid", P(0.3), 0)
    late = x.submit(0, "bid", P(0.3), ONE)
    x.cancel(0, late)  # due at the same instant as its activation, and first
    x.step(150, "delta", "yes", P(0.40), -101 * ONE)  # negative: invalid
    x.submit(150, "bid", P(0.3), ONE)
    x.step(400, "trade", "no", P(0.30), 9 * ONE)
    assert [r[:3] for r in said(x, "rejected", "cancelled")] == [(1, 0, "rejected"), (2, 0, "rejected"), (3, 100, "cancelled"), (4, 250, "rejected")]
    with pytest.raises(ValueError, match="runs back"):
        x.step(399, "gap", None, 0, 0)


@pytest.mark.parametrize(("policy", "left", "fills"), [("cancel_all", 0, 0), ("keep_resting", 2, 1), ("freeze", 2, 0)])
def test_gap_policies(policy, left, fills):
    x = opened(exchange(model="touch", on_gap=policy))
    x.step(200, "gap", None, 0, 0)
    assert len(x.resting) == left
    x.step(300, "trade", "no", P(0.40), 5 * ONE)
    assert len(said(x, "filled")) == fills


def test_inventory_cap_reprice_and_own_fills():
    x = opened(exchange(model="touch", cap=15 * ONE))
    x.step(150, "trade", "no", P(0.40), 10 * ONE)  # long 10: another bid would pass the cap
    x.step(160, "delta", "yes", P(0.42), ONE)  # the best bid moves: no new bid, the ask stays
    assert [r[3] for r in said(x, "submitted")] == ["bid", "ask"]
    x.step(300, "trade", "yes", P(0.45), 10 * ONE)  # flat again: it quotes both sides anew
    assert [r[3:5] for r in said(x, "submitted")][2:] == [("bid", 0.42), ("ask", 0.45)]


def test_strategies():
    lean = backtest.ImbalanceMaker()
    assert lean.quotes(40, 45, 10, 90, 0) == (None, 45) and lean.quotes(40, 45, 50, 50, 0) == (40, 45)
    assert backtest.ImbalanceMaker(policy="flat").quotes(40, 45, 90, 10, 0) == (None, None)
    assert backtest.ImbalanceMaker(policy="step_back").quotes(40_000, 45_000, 10, 90, 0) == (30_000, 45_000)
    skew = backtest.InventorySkew()
    assert skew.quotes(P(0.4), P(0.45), 1, 1, 25 * ONE) == (P(0.38), P(0.45)) and skew.quotes(P(0.4), P(0.45), 1, 1, -25 * ONE) == (P(0.4), P(0.47))


def test_run_matches_the_loop_by_hand(spark):
    import tidebook
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(tidebook)
    feed = [(7, 1, 0, "delta", "yes", "0.40", "100"), (7, 2, 0, "delta", "no", "0.55", "100"), (7, 3, 150, "trade", "no", "0.40", "104"), (7, 4, 160, "gap", None, None, None)]
    events = spark.createDataFrame(feed, "market long, seq long, ms long, kind string, side string, price string, size string").selectExpr("market", "seq", "ms", "kind", "side", "CAST(price AS DECIMAL(12,6)) AS price", "CAST(size AS DECIMAL(24,6)) AS size")
    got = backtest.run(events, models=("touch", "conservative"))
    assert {(r.model, r.fills, str(r.contracts), str(r.cash)) for r in backtest.summary(got).collect()} == {("touch", 1, "10.000000", "-4.000000"), ("conservative", 1, "4.000000", "-1.600000")}
    assert backtest.run(events.limit(0)).count() == 0
