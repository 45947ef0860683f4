"""The backtest as a fold over sorted partitions: one book for all scenarios."""

import itertools
import random

import pytest

from tidebook.operators import backtest
from tidebook.operators.backtest import ONE, Book, Exchange


def feed(seed, n=400):
    rng, ms = random.Random(seed), 0
    for _ in range(n):
        ms += rng.choice((0, 1, 40, 150))
        kind = rng.choice(("delta",) * 6 + ("trade",) * 3 + ("gap",) * (rng.random() < 0.2))
        price = rng.randrange(38, 48) * 10_000
        size = rng.randrange(1, 40) * ONE * (-1 if kind == "delta" and rng.random() < 0.2 else 1)
        yield ms, kind, None if kind == "gap" else rng.choice(("yes", "no")), price, size


def exchanges(book=None):
    for strategy, model, latency in itertools.product(backtest.STRATEGIES.values(), backtest.MODELS.values(), (0, 100)):
        yield Exchange(strategy(), model(), latency, 100, "cancel_all", 10 * ONE, 50 * ONE, 10_000, 10_000, book)


@pytest.mark.parametrize("seed", range(5))
def test_scenarios_that_share_a_book_see_what_they_see_alone(seed):
    book = Book()
    shared, alone = list(exchanges(book)), list(exchanges())
    for event in feed(seed):
        backtest.step(shared, book, *event)
        for x in alone:
            x.settles = False  # asked after every event
            x.step(*event)
        yes, no = (max(book.levels[s], default=None) for s in ("yes", "no"))
        assert book.top == (None if not book.valid or yes is None or no is None else (yes, ONE - no, book.levels["yes"][yes], book.levels["no"][no]))
    assert [x.out for x in shared] == [x.out for x in alone] and any(r[3] == "filled" for x in shared for r in x.out)


def test_only_a_stateless_strategy_is_asked_no_more_than_it_must():
    class Counts:
        def __init__(self, stateless):
            self.stateless, self.asked = stateless, 0

        def quotes(self, bid, ask, bid_size, ask_size, position):
            self.asked += 1
            return bid, ask

    def asked(stateless):
        s = Counts(stateless)
        x = Exchange(s, backtest.Touch(), 100, 100, "cancel_all", 10 * ONE, 50 * ONE, 10_000, 10_000)
        x.step(0, "delta", "yes", 400_000, ONE)
        x.step(0, "delta", "no", 550_000, ONE)
        for k in range(5):
            x.step(1 + k, "delta", "yes", 300_000, ONE)  # behind the touch
        return s.asked

    assert (asked(True), asked(False)) == (1, 6)


def test_a_market_of_many_batches_is_one_run(spark):
    rows = [(3, i, *e) for i, e in enumerate(feed(11, 60))] + [(None, i, *e) for i, e in enumerate(feed(12, 60))]
    events = spark.createDataFrame(rows, "market long, seq long, ms long, kind string, side string, price long, size long").selectExpr("market", "seq", "ms", "kind", "side", "CAST(price / 1e6 AS DECIMAL(12,6)) AS price", "CAST(size / 1e6 AS DECIMAL(24,6)) AS size")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = backtest.run(events, models=("touch",))
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
        got = {m: [(r.order_id, r.step, r.ms, r.state) for r in sorted(found.collect(), key=lambda r: r.step) if r.market == m] for m in (3, None)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for market, seed in ((3, 11), (None, 12)):
        x = Exchange(backtest.JoinBest(), backtest.Touch(), 100, 100, "cancel_all", 10 * ONE, 50 * ONE, 10_000, 10_000)
        for e in feed(seed, 60):
            x.step(*e)
        x.advance(x.now)
        assert got[market] == [r[:4] for r in x.out]
