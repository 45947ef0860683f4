"""Reported queue positions held against the book: transitions, what explains them, and two hypotheses of what the number means.

H0: the queue is what is displayed at the own price; H1: at the own price and better ones. A report lags, so both are taken from the book
as it stood some milliseconds before the poll. Depths are running sums per asked price and one as-of join for all instants; every figure
comes from one table with one row for each pair of successive reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.evidence import LAGS
from tidebook.operators.temporal import asof_join

#: A move below this is none; regimes by ticks from the touch; classes of a move in their order.
TOLERANCE = 1
REGIMES = ("AT_TOUCH", "1_TICK_BEHIND", "2_TICKS_BEHIND", "DEEPER")
LEVEL = ["market", "side", "price"]


def ladder_at(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """asked (market, side, price, at_ms, ...) with ``same``, the size at its price, and ``better``, that at better ones, then.

    ``spans`` (market, side, price, size, from_ms, to_ms): sizes while they hold. Both are null before the market's first span.
    """
    side = ["market", "side"]
    opened = spans.select(*side, F.col("price").alias("p"), F.col("from_ms").alias("at_ms"), F.col("size").alias("d"))
    closed = spans.where("to_ms IS NOT NULL").select(*side, F.col("price").alias("p"), F.col("to_ms").alias("at_ms"), (-F.col("size")).alias("d"))
    # one row for each instant and price first, so that a busy price is small before it meets the asked ones
    moves = opened.unionByName(closed).groupBy(*side, "p", "at_ms").agg(F.sum("d").alias("d"))
    meets = moves.join(asked.select(*LEVEL).distinct(), side).where("p >= price")
    split = lambda cond: F.sum(F.when(cond, F.col("d")).otherwise(0))
    changes = meets.groupBy(*LEVEL, "at_ms").agg(split(F.col("p") > F.col("price")).alias("b"), split(F.col("p") == F.col("price")).alias("s"))
    w = Window.partitionBy(*LEVEL).orderBy("at_ms")
    run = changes.select(*LEVEL, "at_ms", F.sum("b").over(w).cast("decimal(24,6)").alias("better"), F.sum("s").over(w).cast("decimal(24,6)").alias("same"))
    found = asof_join(asked, run, LEVEL, "at_ms", ["better", "same"])
    first = spans.groupBy("market").agg(F.min("from_ms").alias("_first"))
    known = F.col("at_ms") >= F.col("_first")
    return found.join(first, "market", "left").select(*asked.columns, *[F.when(known, F.coalesce(c, F.lit(0))).cast("decimal(24,6)").alias(c) for c in ("better", "same")])


def class_of(moved: Column, same: Column, better: Column, executed: Column, residual: Column) -> Column:
    """What explains a move of the queue, the first that does."""
    within = lambda x: F.abs(x) < TOLERANCE
    return (
        F.when(within(moved), F.when(within(same + better), "SAME_LEVEL_EXPLAINED").otherwise("STILL_UNEXPLAINED")).when(within(moved - executed), "TRADE_EXPLAINED")
        .when(~within(better) & within(moved - same - better), "BETTER_LEVEL_EXPLAINED").when(within(moved - same), "SAME_LEVEL_EXPLAINED").when(residual < TOLERANCE, "POSSIBLE_TIMING_ALIAS").otherwise("STILL_UNEXPLAINED")
    )


def transitions(polls: DataFrame, spans: DataFrame, tops: DataFrame, trades: DataFrame, applied_lag: int, unit: int = 1, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """One row for each two successive reports (probe_id, market, side, price, seq_no, at_ms, queue, and what is carried) of a probe.

    ``tops`` (market, side, ms, best) is the own side's best price after each change, ``trades`` (market, side, price, ms, size) volume taken
    out of a side at a price. Reports without a number are passed over. Columns: moved (how far the queue advanced), same and better at
    both polls and how far they fell, executed at the own price or better in between, ticks from the touch at the first, h0 and h1 levels
    and moves on the book of ``applied_lag`` before, the best lag with its residual, and the class.
    """
    w = Window.partitionBy("probe_id").orderBy("seq_no")
    pairs = polls.where("queue IS NOT NULL").select("*", F.lag("queue").over(w).alias("q0"), F.lag("at_ms").over(w).alias("t0")).where("q0 IS NOT NULL")
    pairs = pairs.withColumnsRenamed({"queue": "q1", "at_ms": "t1"})
    id_ = ["probe_id", "seq_no"]
    wanted = sorted({0, applied_lag, *lags})
    ends = F.array(*[F.struct(F.lit(lag).cast("long").alias("lag"), F.lit(e).alias("e"), (F.col(t) - lag * unit).alias("at_ms")) for lag in wanted for e, t in ((0, "t0"), (1, "t1"))])
    asked = pairs.select(*id_, *LEVEL, F.explode(ends).alias("x")).select(*id_, *LEVEL, "x.*")
    at = lambda c, e: F.max(F.when(F.col("e") == e, F.col(c)))
    by_lag = ladder_at(asked, spans).groupBy(*id_, "lag").agg(*[at(c, e).alias(f"{c}{e}") for c in ("same", "better") for e in (0, 1)])
    moved = pairs.select(*id_, (F.col("q0") - F.col("q1")).alias("moved"))
    predicted = F.col("better0") + F.col("same0") - F.col("better1") - F.col("same1")
    residual = F.abs(F.col("moved") - predicted).cast("decimal(24,6)")
    tried = F.when(F.col("lag").isin(*lags) & predicted.isNotNull(), F.struct(residual.alias("residual"), "lag"))
    pick = lambda lag, c: F.max(F.when(F.col("lag") == lag, F.col(c)))
    books = by_lag.join(moved, id_).groupBy(*id_).agg(
        F.min(tried).alias("found"), *[pick(0, f"{c}{e}").alias(f"{c}{e}") for c in ("same", "better") for e in (0, 1)], *[pick(applied_lag, f"{c}{e}").alias(f"l_{c}{e}") for c in ("same", "better") for e in (0, 1)],
    )
    # where the lagged book is not known, the one at the poll stands for it
    books = books.select(*id_, "found", "same0", "same1", "better0", "better1", *[F.coalesce(f"l_{c}{e}", f"{c}{e}").alias(f"l_{c}{e}") for c in ("same", "better") for e in (0, 1)]).where("same0 IS NOT NULL AND same1 IS NOT NULL")
    traded = _executed(pairs.select(*id_, *LEVEL, "t0", "t1"), trades)
    touch = asof_join(pairs.select(*id_, "market", "side", F.col("t0").alias("ms")), tops, ["market", "side"], "ms", ["best"]).drop("ms", "market", "side")
    rows = pairs.join(books, id_).join(traded, id_, "left").join(touch, id_, "left")
    size = lambda c, name: c.cast("decimal(24,6)").alias(name)
    c = F.col
    full = rows.select(
        *pairs.columns, (c("q0") - c("q1")).alias("moved"), "same0", "same1", "better0", "better1", size(c("same0") - c("same1"), "fell_same"), size(c("better0") - c("better1"), "fell_better"),
        size(F.coalesce("executed", F.lit(0)), "executed"), ((c("best") - c("price")) * 100).cast("int").alias("ticks"), c("l_same1").alias("h0_level"), size(c("l_better1") + c("l_same1"), "h1_level"),
        size(c("l_same0") - c("l_same1"), "h0_moved"), size(c("l_better0") + c("l_same0") - c("l_better1") - c("l_same1"), "h1_moved"), c("found.lag").alias("best_lag"), c("found.residual").alias("residual"),
    )
    return full.withColumn("class", class_of(c("moved"), c("fell_same"), c("fell_better"), c("executed"), c("residual")))


def _executed(pairs: DataFrame, trades: DataFrame) -> DataFrame:
    """(probe_id, seq_no, executed): volume taken at the own price or better in (t0, t1], by the difference of two running sums."""
    level = pairs.select(*LEVEL).distinct()
    met = trades.withColumnRenamed("price", "p").join(level, ["market", "side"]).where("p >= price").groupBy(*LEVEL, F.col("ms").alias("at_ms")).agg(F.sum("size").alias("d"))
    run = met.select(*LEVEL, "at_ms", F.sum("d").over(Window.partitionBy(*LEVEL).orderBy("at_ms")).alias("upto"))
    asked = pairs.select("probe_id", "seq_no", *LEVEL, F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("t0").alias("at_ms")), F.struct(F.lit(1).alias("sign"), F.col("t1").alias("at_ms")))).alias("x"))
    found = asof_join(asked.select("probe_id", "seq_no", *LEVEL, "x.*"), run, LEVEL, "at_ms", ["upto"])
    return found.groupBy("probe_id", "seq_no").agg(F.sum(F.col("sign") * F.coalesce("upto", F.lit(0))).alias("executed"))


def moving() -> Column:
    return F.abs("moved") >= TOLERANCE


def compared(rows: DataFrame) -> DataFrame:
    """Per hypothesis: errors of the level and of its moves, correlation, share of moves explained; one pass over both."""
    both = F.array(*[F.struct(F.lit(name).alias("hypothesis"), F.col(f"{h}_level").cast("double").alias("level"), (F.col("moved") - F.col(f"{h}_moved")).alias("miss")) for name, h in (("H0_same_price", "h0"), ("H1_price_priority", "h1"))])
    each = rows.select(F.col("q1").cast("double").alias("q"), "moved", F.explode(both).alias("x")).select("q", "moved", "x.*")
    off, miss = F.col("q") - F.col("level"), F.abs("miss")
    return each.groupBy("hypothesis").agg(
        F.count("*").alias("observations"), F.avg(F.abs(off)).alias("level_mae"), F.avg(off).alias("level_bias"), F.when(F.count("*") >= 3, F.corr("q", "level")).alias("correlation"),
        F.count_if(moving()).alias("moves"), F.try_divide(F.count_if(moving() & (miss < TOLERANCE)), F.count_if(moving())).alias("explained_rate"), F.avg(F.when(moving(), miss.cast("double"))).alias("move_mae"),
    )


def by_regime(rows: DataFrame) -> DataFrame:
    """Per distance from the touch: what moves, what better levels and the own one did, and the errors of both hypotheses."""
    t = F.coalesce("ticks", F.lit(0))
    regime = F.when(t <= 0, REGIMES[0]).when(t == 1, REGIMES[1]).when(t == 2, REGIMES[2]).otherwise(REGIMES[3])
    n = lambda cond, name: F.count_if(moving() & cond).alias(name)
    b, s, e = F.col("fell_better"), F.col("fell_same"), F.col("executed")
    off = lambda h: F.col("q1").cast("double") - F.col(f"{h}_level").cast("double")
    return rows.groupBy(regime.alias("regime")).agg(
        F.count("*").alias("transitions"), F.count_if(moving()).alias("moves"), n(F.col("class") == "STILL_UNEXPLAINED", "unexplained"), n(F.abs(b) < TOLERANCE, "better_unchanged"), n(b <= -TOLERANCE, "better_increased"),
        n(b >= TOLERANCE, "better_decreased"), n(e >= TOLERANCE, "traded"), n((e < TOLERANCE) & (s >= TOLERANCE), "removed"), n(s <= -TOLERANCE, "added"), n(F.abs(s) < TOLERANCE, "unchanged"),
        *[f(F.abs(off(h)) if kind == "mae" else off(h)).alias(f"{h}_{kind}") for h in ("h0", "h1") for kind, f in (("mae", F.avg), ("bias", F.avg))],
    )


def splits(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, bucket, moves, unexplained) of moves by each of some dimensions, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("dimension"), c.cast("string").alias("bucket")) for name, c in dimensions.items()]))
    return rows.where(moving()).select("class", each.alias("d")).groupBy("d.dimension", "d.bucket").agg(F.count("*").alias("moves"), F.count_if(F.col("class") == "STILL_UNEXPLAINED").alias("unexplained"))


def entry_identity(entries: DataFrame) -> DataFrame:
    """One row: whether a queue at entry is what was displayed (probe_id, displayed, queue, better): exact, mean, median and greatest gap; behind the touch apart.

    The median is the upper of the two in the middle.
    """
    gap = (F.col("displayed") - F.col("queue")).cast("double")
    exact, behind = F.abs(gap) < 0.01, F.coalesce(F.col("better") > 0, F.lit(False))
    rows = entries.where("displayed IS NOT NULL AND queue IS NOT NULL")
    return rows.agg(
        F.count("*").alias("probes"), F.count_if(exact).alias("exact"), F.avg(gap).alias("mean_gap"), F.expr("percentile_disc(0.5000001) WITHIN GROUP (ORDER BY CAST(displayed - queue AS DOUBLE))").alias("median_gap"),
        F.max(F.abs(gap)).alias("max_abs_gap"), F.count_if(behind).alias("behind_touch"), F.count_if(behind & exact).alias("behind_touch_exact"),
    )
