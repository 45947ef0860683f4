"""Positions after every fill at mean entry cost, what they are worth, and how an account fares over time.

Fills are dealt over tasks once, by market, and nothing of them is dealt again or written: quantities, cash and fees are running sums in
a market's order, and only the mean entry price and what is realised at it go from fill to fill, in decimals, over the same rows as they stream
by with a few numbers in hand. Where a market has too many fills for a task (``block``), they are cut where its running quantity is nought or changes
sign, as a position is independent of what was before there, and these segments are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebook.operators import ticks

#: A product of quantity and mean keeps 13 digits: wider types would leave Spark only 6.
QTY, MONEY, MEAN = "decimal(24,6)", "decimal(38,12)", "decimal(24,18)"


def _folded(rows: DataFrame, keys: list[str], step: str) -> DataFrame:
    """rows (keys, place, step, price, ...) with the mean entry price after each, what it realises (``realised``), and that summed (``gained``).

    All rows of the same keys follow one another in a partition, in the order of their places. A row that ``seeds``, where there is such a column, states
    what its keys begin with and does not come out. All other columns pass as they are.
    """
    names = rows.columns

    def fold(batches):
        import decimal

        import pyarrow as pa
        import pyarrow.compute as pc

        exact = decimal.Context(prec=50)
        least, money, nought = decimal.Decimal("1e-18"), decimal.Decimal("1e-12"), decimal.Decimal(0)
        key, at, held, mean, shown, total = None, None, nought, nought, nought, nought
        for batch in batches:
            means, gains, totals = [], [], []
            whole = zip(*[batch.column(c).to_pylist() for c in keys], strict=True)
            for own, place, turn, price in zip(whole, *[batch.column(c).to_pandas().tolist() for c in ("place", step, "price")], strict=True):
                if key != own:
                    key, held, mean, shown, total = own, nought, nought, nought, nought
                elif place <= at:
                    raise ValueError(f"fills of {key} are out of order: {place} after {at}")
                at, gain = place, nought
                if turn:
                    long, size, opened = held > 0, abs(held), abs(turn)
                    if size and long != (turn > 0):
                        closed = min(size, opened)
                        gain = exact.multiply(closed, exact.subtract(price, mean) if long else exact.subtract(mean, price)).quantize(money, context=exact)
                        total = exact.add(total, gain)
                        # past nought the position begins anew, at this price
                        size, opened = nought, exact.subtract(opened, closed)
                    if opened:
                        mean = exact.divide(exact.add(exact.multiply(size, mean), exact.multiply(opened, price)), exact.add(size, opened)) if size else price
                        shown = mean.quantize(least, context=exact)
                    held = exact.add(held, turn)
                means.append(shown)
                gains.append(gain)
                totals.append(total)
            out = [batch.column(c) for c in names] + [pa.array(means, pa.decimal128(24, 18)), pa.array(gains, pa.decimal128(38, 12)), pa.array(totals, pa.decimal128(38, 12))]
            done = pa.RecordBatch.from_arrays(out, names=[*names, "mean", "realised", "gained"])
            yield done.filter(pc.invert(batch.column("seeds"))) if "seeds" in names else done

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    return rows.mapInArrow(fold, f"{kinds}, mean {MEAN}, realised {MONEY}, gained {MONEY}")


def _cash() -> Column:
    """What a fill brings, its fee taken off."""
    return (-F.col("signed_qty") * F.col("price") - F.coalesce("fee", F.lit(0))).cast(MONEY)


def _sums() -> dict[str, Column]:
    return {"cash_so_far": _cash(), "fees_so_far": F.coalesce("fee", F.lit(0)), "unknown_so_far": F.col("fee").isNull().cast("long")}


def in_order(order: list[str] | None = None) -> WindowSpec:
    """A market's fills by these columns, else by place."""
    return Window.partitionBy("market").orderBy(*(order or ["place"]))


def _whole(fills: DataFrame, order: list[str] | None, beside: dict[str, Column]) -> DataFrame:
    """Fills dealt by market, once: running sums, the numbers of the fills and the fold all go over the same sorted rows."""
    w = in_order(order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = [F.row_number().over(w).cast("long").alias("place")] if order else []
    sums = {"qty": F.col("signed_qty"), **_sums()}
    # dealt before any sum is made ready, so that only what is given is shuffled
    rows = fills.repartition("market").select(*[c for c in fills.columns if not c.startswith("_")], *place, *[F.sum(c).over(run).alias(n) for n, c in sums.items()], *[c.alias(n) for n, c in beside.items()])
    return _folded(rows.withColumn("qty", F.col("qty").cast(QTY)), ["market"], "signed_qty").withColumnRenamed("gained", "realised_so_far")


def _cut(fills: DataFrame, block: Column) -> DataFrame:
    """Fills of markets that are cut: sums by blocks, the fold by segments between points where nothing is open or the side changes."""
    q, before = F.col("signed_qty"), F.col("qty") - F.col("signed_qty")
    rows = ticks.running(fills, ["market"], "place", {"qty": ("sum", q)}, block).withColumn("qty", F.col("qty").cast(QTY))
    against = before * q < 0
    begins = ((before == 0) & (q != 0)) | (against & (F.abs(q) > F.abs(before)))
    rows = ticks.running(rows.withColumn("_begins", begins.cast("long")), ["market"], "place", {"segment": ("sum", F.col("_begins"))}, block)
    # a fill that turns a position closes the old segment and states what the new one begins with
    turned = F.struct((F.col("segment") - 1).alias("segment"), F.lit(False).alias("seeds")), F.struct("segment", F.lit(True).alias("seeds"))
    own = F.array(F.struct("segment", F.lit(False).alias("seeds")))
    dealt = rows.withColumn("_x", F.explode(F.when((F.col("_begins") == 1) & against, F.array(*turned)).otherwise(own)))
    dealt = dealt.withColumns({"segment": F.col("_x.segment"), "seeds": F.col("_x.seeds"), "step": F.when(F.col("_x.seeds"), F.col("qty")).otherwise(q)}).drop("_begins", "_x")
    tasks = int(fills.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _folded(dealt.repartition(tasks, "market", "segment").sortWithinPartitions("market", "segment", "place"), ["market", "segment"], "step")
    sums = {"realised_so_far": F.col("realised"), **_sums()}
    return ticks.running(found.drop("gained"), ["market"], "place", {n: ("sum", c) for n, c in sums.items()}, block)


def positions(fills: DataFrame, block: Column | None = None, order: list[str] | None = None, beside: dict[str, Column] | None = None) -> DataFrame:
    """One row for each fill (market, place, signed_qty, price, fee): the position after it.

    ``place`` orders a market's fills, without ties; with ``order``, the fills come without it and are numbered in the order of these columns, of
    which those that begin with ``_`` do not come out. A fill first closes what is open on the other side, at its mean entry price, and
    then opens what is left. Columns: before, qty, closed, mean (0 where flat), realised (by this fill), cash (by this fill,
    its fee taken off), and running over the market realised_so_far, cash_so_far, fees_so_far. A null fee is unknown: it is counted in
    unknown_so_far and costs nothing. ``beside`` are further columns over the window :func:`in_order` of the same order. ``block`` cuts a
    market's fills where they are too many for a task; it needs ``place``.
    """
    if block is not None and (order or beside):
        raise ValueError("fills that are cut into blocks need a place, and no columns beside")
    q, before = F.col("signed_qty"), (F.col("qty") - F.col("signed_qty")).cast(QTY)
    found = _whole(fills, order, beside or {}) if block is None else _cut(fills, block)
    closed = F.when(before * q < 0, F.least(F.abs(before), F.abs(q))).otherwise(0).cast(QTY)
    given = [c for c in fills.columns if not c.startswith("_")] + (["place"] if order else [])
    return found.select(
        *given, *(beside or {}), before.alias("before"), "qty", closed.alias("closed"), F.when(F.col("qty") != 0, F.col("mean")).otherwise(0).cast(MEAN).alias("mean"), "realised", _cash().alias("cash"),
        *[F.col(c).cast(MONEY).alias(c) for c in ("realised_so_far", "cash_so_far", "fees_so_far")], "unknown_so_far",
    )


def unrealised(qty: Column, mean: Column, mark: Column) -> Column:
    """What an open position would bring at its mark: nought when flat, null without a mark."""
    return F.when(qty == 0, F.lit(0)).otherwise(qty * (mark.cast("decimal(12,6)") - mean)).cast(MONEY)


def collateral(qty: Column, mean: Column) -> Column:
    """Capital that a position ties up: a long's cost, a short's worst case."""
    return F.when(qty > 0, qty * mean).otherwise(-qty * (1 - mean)).cast(MONEY)


def settled(qty: Column, mean: Column, payout: Column) -> tuple[Column, Column]:
    """(cash, profit) of a position that pays out."""
    return (qty * payout.cast("decimal(12,6)")).cast(MONEY), (qty * (payout.cast("decimal(12,6)") - mean)).cast(MONEY)


def voided(qty: Column, mean: Column) -> tuple[Column, Column]:
    """(cash, profit) of a position whose market is void: it comes back at cost."""
    return (qty * mean).cast(MONEY), F.lit(0).cast(MONEY)


def equity_sums(states: DataFrame, at: str = "at_ms") -> DataFrame:
    """Sums for each instant over the positions in force there: (at, market, qty, mean, mark, realised, settled, cash, fees, unknown).

    A position without a mark is counted and its quantity stated, and leaves only its unrealised part out: what it has realised stays.
    """
    open_ = F.col("qty") != 0
    gain = unrealised(F.col("qty"), F.col("mean"), F.col("mark"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)
    return states.groupBy(at).agg(
        total("cash").alias("cash"), total("realised").alias("realised"), total("settled").alias("settlement"), total(gain).alias("unrealised"), total("fees").alias("fees"),
        F.sum("unknown").alias("unknown"), F.sum("qty").cast(QTY).alias("net_inventory"), F.sum(F.abs("qty")).cast(QTY).alias("abs_inventory"),
        total(collateral(F.col("qty"), F.col("mean"))).alias("collateral"), F.count_if(open_).alias("positions"), F.count_if(open_ & F.col("mark").isNull()).alias("unmarked_positions"),
        F.coalesce(F.sum(F.when(open_ & F.col("mark").isNull(), F.abs("qty"))), F.lit(0)).cast(QTY).alias("unmarked_quantity"),
        total(F.when(open_, F.col("qty") * F.col("mark").cast("decimal(12,6)"))).alias("worth"), F.count("market").alias("markets"),
    )


def equity_curve(sums: DataFrame, grid: DataFrame, at: str = "at_ms") -> DataFrame:
    """One row for each instant of ``grid`` out of its sums; where there are none the account is empty. With any unknown fee the net is null."""
    zero = F.lit(0)
    full = grid.select(at).join(sums, at, "left").fillna(0)
    gross = (F.col("realised") + F.col("settlement") + F.col("unrealised")).cast(MONEY)
    return full.select(
        at, "cash", "realised", "settlement", "unrealised", gross.alias("gross"), F.when(F.col("unknown") == zero, (gross - F.col("fees")).cast(MONEY)).alias("net"), "fees",
        (F.col("unknown") == zero).alias("fee_verified"), "net_inventory", "abs_inventory", "collateral", "positions", "unmarked_positions", "unmarked_quantity",
        (F.col("cash") + F.col("worth")).cast(MONEY).alias("equity"),
    )


def equity_rows(states: DataFrame, grid: DataFrame, at: str = "at_ms") -> DataFrame:
    """One row for each instant of ``grid`` out of positions in force there, as :func:`equity_sums` takes them."""
    return equity_curve(equity_sums(states, at), grid, at)


def run_figures(curve: DataFrame, first_ms: Column, last_ms: Column, at: str = "at_ms") -> DataFrame:
    """One row of an equity curve: greatest and time-weighted mean inventory, greatest collateral and drawdown, and where it ends.

    The curve is one row for each instant of a coarse grid, so its order is one sorted column of few values.
    """
    w = Window.orderBy(at)
    held = F.lead(at).over(w) - F.col(at)
    peak = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.select("*", held.alias("_held"), (peak - F.col("equity")).alias("_down"))
    last = lambda c: F.max_by(c, at).alias(f"final_{c}")
    return rows.agg(
        F.max("abs_inventory").alias("max_abs_inventory"), (F.sum(F.col("abs_inventory").cast("double") * F.col("_held")) / F.first(last_ms - first_ms)).alias("mean_abs_inventory"),
        F.max("collateral").alias("max_collateral"), F.max("_down").cast(MONEY).alias("max_drawdown"),
        *[last(c) for c in ("realised", "settlement", "unrealised", "gross", "net", "fees", "abs_inventory", "positions", "unmarked_positions", "unmarked_quantity")],
    )
