"""Queries of positions, settlement, equity and run figures; their oracles go from fill to fill by recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import scalar as S
from tidebook.operators import accounts, temporal
from tidebook.plans.books import _shipped
from tidebook.plans.market import DAY
from tidebook.storage import stage_table
from tidebook.tables import view

#: Days of the equity grid; a determined market pays out so long after its last fill.
GRID, DETERMINED = 90 * DAY, 60 * DAY
LIFT = 3e-9


#: A market's order of fills; columns with _ are needed for nothing else.
ORDER = ["ms", "_order_id", "_line", "price", "signed_qty", "_discount"]


def _fills(spark: SparkSession, d: str) -> DataFrame:
    """Fills with what orders a market's; no fee is known of those returned as N."""
    signed = F.when(F.col("action") == "buy", F.col("qty")).otherwise(-F.col("qty")).cast("decimal(24,6)")
    fee = F.when(F.col("l_returnflag") != "N", F.col("discount"))
    return view(spark, d, "fills").select("market", "ms", signed.alias("signed_qty"), F.col("price").cast("decimal(12,6)").alias("price"), fee.alias("fee"),
                                          F.col("order_id").alias("_order_id"), F.col("line").alias("_line"), F.col("discount").alias("_discount"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    _shipped()
    return accounts.positions(_fills(spark, d), order=ORDER)


def _near(c: Column, n: int = 4) -> Column:
    """c to n digits. Halves are lifted first: a double may lie on either side of one, and engines part there."""
    return F.round(c.cast("double") + LIFT, n)


def _rounded(c: str, n: int = 4) -> Column:
    return _near(F.col(c), n).alias(c)


def position_states(spark: SparkSession, d: str) -> DataFrame:
    """A market's position after each of its fills."""
    return _states(spark, d).select("market", "place", "qty", "closed", _rounded("mean", 6), _rounded("realised"), F.col("cash").cast("decimal(24,6)").alias("cash"), _rounded("realised_so_far"))


def position_fold(spark: SparkSession, d: str) -> DataFrame:
    """A market's position at the end: quantity, cost and collateral of what is open, realised profit and cash before fees."""
    last = _states(spark, d).groupBy("market").agg(F.max_by(F.struct("qty", "mean", "realised_so_far", "cash_so_far", "fees_so_far"), "place").alias("s")).select("market", "s.*")
    cost, tied = (F.col("qty") * F.col("mean")).cast("double"), accounts.collateral(F.col("qty"), F.col("mean")).cast("double")
    return last.select("market", "qty", _near(cost).alias("cost"), _near(tied).alias("collateral"), _near(F.col("realised_so_far")).alias("realised"), (F.col("cash_so_far") + F.col("fees_so_far")).cast("decimal(28,6)").alias("cash"))


def _determined(spark: SparkSession, d: str) -> DataFrame:
    """(market, state, payout, basis, provisional) of the markets that are defined."""
    defined = view(spark, d, "markets").where("market % 10 <> 9").withColumn("state", S.lifecycle_state(F.col("status"), F.col("result")))
    payout, basis = S.yes_payout(F.col("state"), F.col("settlement_value"), F.col("notional_value"))
    return defined.select("market", "state", payout.alias("payout"), basis.alias("basis"), (F.col("market") % 8 == 0).alias("provisional"))


def settlement(spark: SparkSession, d: str) -> DataFrame:
    """Positions at the end by what becomes of them: payout at its basis, a void market's at cost; cash and profit that it brings."""
    last = _states(spark, d).groupBy("market").agg(F.max_by(F.struct("qty", "mean"), "place").alias("s")).select("market", "s.*")
    rows = last.join(_determined(spark, d), "market", "left")
    rows = rows.withColumn("resolution", S.resolution(F.col("qty"), F.col("state").isNotNull(), F.col("state"), F.col("payout"), F.col("market") % 6 != 0)).where("resolution IS NOT NULL")
    paid, void = accounts.settled(F.col("qty"), F.col("mean"), F.col("payout")), accounts.voided(F.col("qty"), F.col("mean"))
    done, back = F.col("resolution") == "SETTLED", F.col("resolution") == "VOIDED"
    cash, gain = (F.when(done, a).when(back, b) for a, b in zip(paid, void, strict=True))
    return rows.groupBy("resolution", F.when(done, F.col("basis")).alias("basis")).agg(
        F.count("*").alias("n"), F.count_if(done & F.col("provisional")).alias("provisional"), _near(F.sum(cash)).alias("cash"), _near(F.sum(gain)).alias("pnl")
    )


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    """Sums of the account on the equity grid, the grid, and an instant after it, at which the sums tell of every market.

    A market's last price is its mark, some have none. A determined market pays out late: its end goes along with its fills, as one of no
    contracts at its payout, or at none where it is void, and stands behind them all.
    """
    _shipped()
    fills = _fills(spark, d)
    first, stop = fills.agg(F.min("ms"), F.max("ms")).first()
    first, stop = first or 0, (stop or 0) + DETERMINED
    closing = (stop // GRID + 1) * GRID
    known = _determined(spark, d).where("state = 'VOIDED' OR payout IS NOT NULL")
    zero = F.lit(0)
    ends = known.select("market", F.lit(None).cast("long").alias("ms"), zero.cast("decimal(24,6)").alias("signed_qty"), F.when(F.col("state") == "VOIDED", None).otherwise(F.col("payout")).cast("decimal(12,6)").alias("price"),
                        zero.cast("decimal(12,6)").alias("fee"), F.lit(True).alias("over"))
    both = fills.withColumn("over", F.lit(False)).unionByName(ends, allowMissingColumns=True)

    order = ["over", *ORDER]
    w, late = accounts.in_order(order), F.lit(DETERMINED)
    times = {
        "since": F.when(F.col("over"), F.lag("ms").over(w) + late).otherwise(F.col("ms")),
        "until": F.when(F.lead("over").over(w), F.col("ms") + late).otherwise(F.lead("ms").over(w)),
    }
    states = accounts.positions(both, order=order, beside=times)
    spans = states.withColumn("_to", F.coalesce(F.col("until") - 1, F.lit(closing)))
    over, void = F.col("over"), F.col("price").isNull()
    (cash, gain), (back, none) = accounts.settled(F.col("qty"), F.col("mean"), F.col("price")), accounts.voided(F.col("qty"), F.col("mean"))
    cells = temporal.grid(spans, "since", "_to", GRID, "at_ms").select(
        "at_ms", "market", F.when(over, zero).otherwise(F.col("qty")).cast(accounts.QTY).alias("qty"), F.when(over, zero).otherwise(F.col("mean")).cast(accounts.MEAN).alias("mean"),
        F.when(F.col("market") % 6 > 0, F.col("price")).alias("mark"), F.col("realised_so_far").alias("realised"), F.when(over, F.when(void, none).otherwise(gain)).otherwise(zero).cast(accounts.MONEY).alias("settled"),
        (F.col("cash_so_far") + F.when(over, F.when(void, back).otherwise(cash)).otherwise(zero)).cast(accounts.MONEY).alias("cash"), F.col("fees_so_far").alias("fees"), F.col("unknown_so_far").alias("unknown"),
    )
    grid = temporal.grid(spark.range(1).select((F.lit(first) - GRID).alias("a"), F.lit(stop).alias("b")), "a", "b", GRID, "at_ms")
    return accounts.equity_sums(cells), grid, closing


def equity_grid(spark: SparkSession, d: str) -> DataFrame:
    """The account on a 90-day grid: cash, profit by kind, inventory and collateral; positions without a mark counted apart."""
    sums, grid, _ = _cells(spark, d)
    return accounts.equity_curve(sums, grid).select("at_ms", *[_rounded(c) for c in ("cash", "realised", "settlement", "unrealised", "gross", "net", "fees", "collateral", "equity")],
                                                    "fee_verified", "net_inventory", "abs_inventory", "positions", "unmarked_positions", "unmarked_quantity")


def portfolio_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row on the whole run: inventory over time, collateral, drawdown, profit by day, market and fill."""
    sums, grid, closing = _cells(spark, d)
    sums = stage_table(sums, "account")  # a row for each instant
    span = _fills(spark, d).agg(F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count("*").alias("fills"), F.sum(F.abs("signed_qty")).cast("decimal(28,6)").alias("contracts"), F.sum(F.abs("signed_qty") * F.col("price")).cast("decimal(28,6)").alias("notional"))
    span = stage_table(span.crossJoin(sums.where(F.col("at_ms") == closing).agg(F.coalesce(F.sum("markets"), F.lit(0)).alias("markets"))), "span")
    curve = accounts.equity_curve(sums, grid)
    both = curve.crossJoin(span)  # one row
    out = accounts.run_figures(both, F.col("first_ms"), F.col("last_ms")).crossJoin(span)
    gross = F.col("final_gross").cast("double")
    each = lambda n: _near(F.try_divide(gross, n), 6)
    return out.select(
        "markets", "fills", "contracts", "notional", "max_abs_inventory", _near(F.col("mean_abs_inventory")).alias("mean_abs_inventory"), _rounded("max_collateral"), _rounded("max_drawdown"),
        _rounded("final_realised"), _rounded("final_settlement"), _rounded("final_unrealised"), _rounded("final_gross"), _rounded("final_net"), _rounded("final_fees"), "final_abs_inventory", "final_positions",
        "final_unmarked_positions", "final_unmarked_quantity", each((F.col("last_ms") - F.col("first_ms")) / DAY).alias("gross_per_day"), each(F.col("markets")).alias("gross_per_market"), each(F.col("fills")).alias("gross_per_fill"),
    )


_WALK = """chain AS (SELECT market, ms, CASE action WHEN 'buy' THEN qty ELSE -qty END AS sq, CAST(price AS DECIMAL(12,6)) AS price, CASE WHEN l_returnflag <> 'N' THEN discount END AS fee,
      row_number() OVER (PARTITION BY market ORDER BY ms, order_id, line, price, CASE action WHEN 'buy' THEN qty ELSE -qty END, discount) AS i FROM fills),
    walk AS (SELECT market, CAST(NULL AS BIGINT) AS ms, CAST(0 AS BIGINT) AS i, CAST(0 AS DECIMAL(24,6)) AS q, CAST(0 AS DECIMAL(24,6)) AS closed, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS gain, CAST(0 AS DOUBLE) AS realised, CAST(0 AS DECIMAL(28,6)) AS cash,
        CAST(0 AS DECIMAL(28,6)) AS step, CAST(0 AS DECIMAL(28,6)) AS fees, CAST(0 AS BIGINT) AS unknown, CAST(0 AS DECIMAL(12,6)) AS price FROM (SELECT DISTINCT market FROM chain) x
      UNION ALL SELECT w.market, c.ms, c.i, CAST(w.q + c.sq AS DECIMAL(24,6)), CAST(CASE WHEN w.q * c.sq < 0 THEN least(abs(w.q), abs(c.sq)) ELSE 0 END AS DECIMAL(24,6)),
        CASE WHEN w.q + c.sq = 0 THEN 0 WHEN w.q * c.sq >= 0 THEN (abs(w.q) * w.mean + abs(c.sq) * CAST(c.price AS DOUBLE)) / (abs(w.q) + abs(c.sq)) WHEN abs(c.sq) > abs(w.q) THEN c.price ELSE w.mean END,
        CASE WHEN w.q * c.sq < 0 THEN least(abs(w.q), abs(c.sq)) * (c.price - w.mean) * sign(w.q) ELSE 0 END,
        w.realised + CASE WHEN w.q * c.sq < 0 THEN least(abs(w.q), abs(c.sq)) * (c.price - w.mean) * sign(w.q) ELSE 0 END,
        CAST(w.cash - c.sq * CAST(c.price AS DECIMAL(4,2)) - coalesce(c.fee, 0) AS DECIMAL(28,6)), CAST(-c.sq * CAST(c.price AS DECIMAL(4,2)) - coalesce(c.fee, 0) AS DECIMAL(28,6)), CAST(w.fees + coalesce(c.fee, 0) AS DECIMAL(28,6)), w.unknown + CASE WHEN c.fee IS NULL THEN 1 ELSE 0 END, c.price
      FROM walk w JOIN chain c ON c.market = w.market AND c.i = w.i + 1),
    ends AS (SELECT * FROM walk QUALIFY i = max(i) OVER (PARTITION BY market)),
    said AS (SELECT market, settlement_value AS sv, coalesce(notional_value, 1) AS nv, lower(trim(coalesce(result, ''))) AS r, lower(trim(coalesce(status, ''))) AS s FROM markets WHERE market % 10 <> 9),
    known AS (SELECT market, r, s, r IN ('void', 'canceled') AS void, CASE WHEN sv IS NOT NULL THEN CASE WHEN nv > 0 THEN sv / nv END WHEN r = 'yes' THEN 1 WHEN r = 'no' THEN 0 END AS p, CASE WHEN sv IS NULL THEN 'result' ELSE 'settlement_value' END AS basis FROM said)"""
_EQUITY = f"""{_WALK}, days AS (SELECT market, ms, q, mean, realised, 0.0 AS settled, CAST(cash AS DOUBLE) AS cash, fees, unknown, price FROM walk WHERE i > 0 QUALIFY i = max(i) OVER (PARTITION BY market, ms)),
    over AS (SELECT e.market, e.ms + {DETERMINED} AS ms, CAST(0 AS DECIMAL(24,6)) AS q, 0.0 AS mean, e.realised, CASE WHEN k.void THEN 0 ELSE e.q * (CAST(k.p AS DECIMAL(12,6)) - e.mean) END AS settled, e.cash + CASE WHEN k.void THEN e.q * e.mean ELSE e.q * CAST(k.p AS DECIMAL(12,6)) END AS cash, e.fees, e.unknown, e.price
      FROM ends e JOIN known k ON k.market = e.market WHERE k.void OR k.p IS NOT NULL),
    b AS (SELECT unnest(generate_series((SELECT CAST(ceil(min(ms) / {GRID}.0) AS BIGINT) - 1 FROM days), (SELECT (max(ms) + {DETERMINED}) // {GRID} FROM days))) * {GRID} AS at_ms),
    cells AS (SELECT b.at_ms, x.* FROM b JOIN (SELECT * FROM days UNION ALL SELECT * FROM over) x ON x.ms <= b.at_ms QUALIFY row_number() OVER (PARTITION BY b.at_ms, x.market ORDER BY x.ms DESC) = 1),
    curve AS (SELECT b.at_ms, coalesce(sum(c.cash), 0) AS cash, coalesce(sum(realised), 0) AS realised, coalesce(sum(settled), 0) AS settlement, coalesce(sum(CASE WHEN market % 6 > 0 THEN q * (price - mean) END), 0) AS unrealised, coalesce(sum(fees), 0) AS fees, coalesce(sum(unknown), 0) AS unknown,
      CAST(coalesce(sum(q), 0) AS DECIMAL(24,6)) AS net_inventory, CAST(coalesce(sum(abs(q)), 0) AS DECIMAL(24,6)) AS abs_inventory, coalesce(sum(CASE WHEN q > 0 THEN q * mean ELSE abs(q) * (1 - mean) END), 0) AS collateral, count(*) FILTER (q <> 0) AS positions,
      count(*) FILTER (q <> 0 AND market % 6 = 0) AS unmarked_positions, CAST(coalesce(sum(abs(q)) FILTER (market % 6 = 0), 0) AS DECIMAL(24,6)) AS unmarked_quantity, coalesce(sum(CASE WHEN market % 6 > 0 THEN q * price END), 0) AS worth FROM b LEFT JOIN cells c ON c.at_ms = b.at_ms GROUP BY b.at_ms),
    priced AS (SELECT *, realised + settlement + unrealised AS gross, CASE WHEN unknown = 0 THEN realised + settlement + unrealised - fees END AS net, cash + worth AS equity FROM curve)"""
_R = lambda *names: ", ".join(f"round(CAST({n} AS DOUBLE) + {LIFT}, 4) AS {n}" for n in names)

ORACLES: dict[str, str] = {
    "position_states": f"WITH RECURSIVE {_WALK} SELECT market, i AS place, q AS qty, closed, round(mean + {LIFT}, 6) AS mean, round(gain + {LIFT}, 4) AS realised, CAST(step AS DECIMAL(24,6)) AS cash, round(realised + {LIFT}, 4) AS realised_so_far FROM walk WHERE i > 0",
    "position_fold": f"WITH RECURSIVE {_WALK} SELECT market, q AS qty, round(q * mean + {LIFT}, 4) AS cost, round(CASE WHEN q > 0 THEN q * mean ELSE -q * (1 - mean) END + {LIFT}, 4) AS collateral, round(realised + {LIFT}, 4) AS realised, CAST(cash + fees AS DECIMAL(28,6)) AS cash FROM ends",
    "settlement": f"""WITH RECURSIVE {_WALK}, x AS (SELECT e.market, e.q, e.mean, k.*, k.market IS NOT NULL AS defined FROM ends e LEFT JOIN known k ON k.market = e.market WHERE q <> 0),
        y AS (SELECT *, CASE WHEN void THEN 'VOIDED' WHEN p IS NOT NULL THEN 'SETTLED' WHEN market % 6 = 0 THEN 'UNPRICEABLE' WHEN defined AND r NOT IN ('yes', 'no') AND s IN ('closed', 'determined', 'settled') THEN 'AWAITING_DETERMINATION' ELSE 'OPEN_AT_RUN_END' END AS resolution FROM (SELECT * EXCLUDE (market_1) FROM x) z)
        SELECT resolution, CASE resolution WHEN 'SETTLED' THEN basis END AS basis, count(*) AS n, count(*) FILTER (WHERE resolution = 'SETTLED' AND market % 8 = 0) AS provisional,
          round(sum(CASE resolution WHEN 'SETTLED' THEN q * CAST(p AS DECIMAL(12,6)) WHEN 'VOIDED' THEN q * mean END) + {LIFT}, 4) AS cash, round(sum(CASE resolution WHEN 'SETTLED' THEN q * (CAST(p AS DECIMAL(12,6)) - mean) WHEN 'VOIDED' THEN 0 END) + {LIFT}, 4) AS pnl FROM y GROUP BY ALL""",
    "equity_grid": f"WITH RECURSIVE {_EQUITY} SELECT at_ms, {_R('cash', 'realised', 'settlement', 'unrealised', 'gross', 'net', 'fees', 'collateral', 'equity')}, unknown = 0 AS fee_verified, net_inventory, abs_inventory, positions, unmarked_positions, unmarked_quantity FROM priced",
    "portfolio_summary": f"""WITH RECURSIVE {_EQUITY}, t AS (SELECT min(ms) AS a, max(ms) AS z, count(DISTINCT market) AS markets, count(*) AS fills, CAST(sum(abs(sq)) AS DECIMAL(28,6)) AS contracts, CAST(sum(abs(sq) * CAST(price AS DECIMAL(4,2))) AS DECIMAL(28,6)) AS notional FROM chain),
        g AS (SELECT *, lead(at_ms) OVER (ORDER BY at_ms) - at_ms AS held, max(equity) OVER (ORDER BY at_ms ROWS UNBOUNDED PRECEDING) - equity AS down, row_number() OVER (ORDER BY at_ms DESC) AS back FROM priced)
        SELECT any_value(markets) AS markets, any_value(fills) AS fills, any_value(contracts) AS contracts, any_value(notional) AS notional, max(abs_inventory) AS max_abs_inventory, round(sum(CAST(abs_inventory AS DOUBLE) * held) / any_value(z - a) + {LIFT}, 4) AS mean_abs_inventory,
          round(max(collateral) + {LIFT}, 4) AS max_collateral, round(max(down) + {LIFT}, 4) AS max_drawdown, {", ".join(f"round(CAST(any_value({c}) FILTER (back = 1) AS DOUBLE) + {LIFT}, 4) AS final_{c}" for c in ("realised", "settlement", "unrealised", "gross", "net", "fees"))},
          any_value(abs_inventory) FILTER (back = 1) AS final_abs_inventory, any_value(positions) FILTER (back = 1) AS final_positions, any_value(unmarked_positions) FILTER (back = 1) AS final_unmarked_positions, any_value(unmarked_quantity) FILTER (back = 1) AS final_unmarked_quantity,
          round(any_value(gross) FILTER (back = 1) / (any_value(z - a) / {DAY}.0) + {LIFT}, 6) AS gross_per_day, round(any_value(gross) FILTER (back = 1) / any_value(markets) + {LIFT}, 6) AS gross_per_market, round(any_value(gross) FILTER (back = 1) / any_value(fills) + {LIFT}, 6) AS gross_per_fill FROM g, t""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (position_states, position_fold, settlement, equity_grid, portfolio_summary)}
