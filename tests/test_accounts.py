"""Positions, settlement and equity against a plain account."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidebook.operators import accounts

FILLS = "market long, place long, signed_qty decimal(24,6), price decimal(12,6), fee decimal(12,6)"


def account(fills):
    """(qty, mean, realised, cash, closed) after each fill of one market, in fractions."""
    q = mean = realised = cash = Fraction(0)
    for _, _, s, p, fee in fills:
        s, p = Fraction(s), Fraction(p)
        closed = min(abs(q), abs(s)) if q * s < 0 else Fraction(0)
        realised += closed * (p - mean) * (1 if q > 0 else -1)
        if closed == 0:
            mean = (abs(q) * mean + abs(s) * p) / (abs(q) + abs(s)) if s else mean
        elif abs(s) > closed:
            mean = p
        q += s
        mean = mean if q else Fraction(0)
        cash -= s * p + Fraction(fee or 0)
        yield q, mean, realised, cash, closed


@pytest.mark.parametrize("block", [None, "place div 5"])
def test_positions_equal_an_account_in_fractions(spark, block):
    rng = random.Random(9)
    dec = lambda x: Decimal(x).quantize(Decimal("0.000001"))
    rows = [(m, i, dec(rng.choice((-7, -3, -1, 1, 2, 5, 0 if m == 3 else 4))), dec(rng.randrange(1, 99)) / 100, dec(rng.randrange(3)) / 10 if rng.random() < 0.8 else None) for m in range(4) for i in range(60)]
    rows += [(9, 1, dec(2), dec("0.4"), dec(0)), (9, 2, dec(-2), dec("0.5"), dec(0)), (9, 3, dec(-1), dec("0.5"), None), (9, 4, dec(4), dec("0.3"), None)]  # flat, short, turned
    got = {(r.market, r.place): r for r in accounts.positions(spark.createDataFrame(rows, FILLS), None if block is None else F.expr(block)).collect()}
    assert len(got) == len(rows)
    for market in {r[0] for r in rows}:
        own, before = [r for r in rows if r[0] == market], Fraction(0)
        for row, (q, mean, realised, cash, closed) in zip(own, account(own), strict=True):
            r = got[row[:2]]
            assert (r.qty, r.closed, r.before, r.cash_so_far) == (q, closed, q - Fraction(row[2]), cash)
            assert abs(Fraction(r.mean) - mean) < Fraction(1, 10**15) and abs(Fraction(r.realised_so_far) - realised) < Fraction(1, 10**9)
            assert abs(Fraction(r.realised) - (realised - before)) < Fraction(1, 10**10)
            before = realised
        assert got[own[-1][:2]].unknown_so_far == sum(r[4] is None for r in own)
    assert accounts.positions(spark.createDataFrame([], FILLS)).count() == 0


def test_equity_keeps_what_an_unmarked_position_has_realised(spark):
    d = lambda x: None if x is None else Decimal(str(x))
    rows = [  # at, market, qty, mean, mark, realised, settled, cash, fees, unknown
        (10, 1, 5, 0.4, 0.5, 1.5, 0, -2, 0.1, 0), (10, 2, -3, 0.7, None, 2.5, 0, 4, 0.2, 0), (10, 3, 0, 0, None, 0.5, 0.25, 1, 0, 0),
        (20, 1, 5, 0.4, 0.2, 1.5, 0, -2, 0.1, 0), (20, 2, -3, 0.7, 0.9, 2.5, 0, 4, 0.2, 1),
    ]
    table = spark.createDataFrame([(a, m, *map(d, r[:-1]), r[-1]) for a, m, *r in rows], f"at_ms long, market long, qty {accounts.QTY}, mean {accounts.MEAN}, mark decimal(12,6), realised {accounts.MONEY}, settled {accounts.MONEY}, cash {accounts.MONEY}, fees {accounts.MONEY}, unknown long")
    grid = spark.createDataFrame([(0,), (10,), (20,)], "at_ms long")
    curve = accounts.equity_rows(table, grid)
    got = {r.at_ms: r for r in curve.collect()}
    a, b, c = got[0], got[10], got[20]
    assert (a.cash, a.gross, a.net, a.positions, a.fee_verified) == (0, 0, 0, 0, True)
    assert (b.realised, b.settlement, b.unrealised, b.gross, b.net) == (d(4.5), d(0.25), d(0.5), d(5.25), d(4.95))
    assert (b.collateral, b.positions, b.unmarked_positions, b.unmarked_quantity, b.net_inventory, b.abs_inventory, b.equity) == (d(2.9), 2, 1, 3, 2, 8, d(5.5))
    assert (c.unrealised, c.gross, c.net, c.fee_verified, c.equity) == (d(-1.6), d(2.4), None, False, d(0.3))
    run = accounts.run_figures(curve, F.lit(0), F.lit(20)).first()
    assert (run.max_abs_inventory, run.mean_abs_inventory, run.max_collateral, run.max_drawdown, run.final_gross) == (8, 4.0, d(2.9), d(5.2), d(2.4))


def test_a_void_position_comes_back_at_cost(spark):
    row = spark.createDataFrame([(Decimal(-4), Decimal("0.3"))], f"q {accounts.QTY}, m {accounts.MEAN}")
    paid, void = accounts.settled(F.col("q"), F.col("m"), F.lit(1)), accounts.voided(F.col("q"), F.col("m"))
    assert tuple(row.select(*paid, *void).first()) == (Decimal(-4), Decimal("-2.8"), Decimal("-1.2"), 0)
