"""Evidence between a reported queue and the book: depth ahead at instants, and the lag that explains a move best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators.temporal import asof_join

#: Candidate lags in milliseconds.
LAGS = tuple(range(-500, 2501, 100))


def depth_ahead_at(asked: DataFrame, intervals: DataFrame) -> DataFrame:
    """asked (market, side, price, at_ms) and ``ahead``, the size at its price and better ones at that instant.

    A change of a level counts for every asked price of its market and side that is not better than it: prices lie on
    the tick grid, so those are few. Null before the first change that counts; 0 where the book has emptied.
    """
    level = ["market", "side"]
    opened = intervals.select(*level, F.col("price").alias("p"), F.col("from_ms").alias("at_ms"), F.col("size").alias("d"))
    closed = intervals.where("to_ms IS NOT NULL").select(*level, F.col("price").alias("p"), F.col("to_ms").alias("at_ms"), (-F.col("size")).alias("d"))
    prices = asked.select(*level, "price").distinct()
    changes = opened.unionByName(closed).join(prices, level).where("p >= price").groupBy(*level, "price", "at_ms").agg(F.sum("d").alias("d"))
    run = F.sum("d").over(Window.partitionBy(*level, "price").orderBy("at_ms")).cast("decimal(24,6)")
    return asof_join(asked, changes.withColumn("ahead", run), [*level, "price"], "at_ms", ["ahead"])


def lag_search(readings: DataFrame, intervals: DataFrame, unit: int = 1, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """readings (id, market, side, price, t0, t1, moved) and the lag whose book move is nearest to ``moved``, with its residual.

    Both instants are shifted back by the lag (in units of ``unit`` milliseconds); the book's move is the fall of the
    depth ahead between them. Lags at which either depth is unknown are left out, the first least residual wins, and
    a reading without any has nulls.
    """
    tried = readings.withColumn("lag", F.explode(F.array(*[F.lit(x).cast("long") for x in lags])))
    ends = tried.select("id", "lag", "market", "side", "price", "moved", F.expr("explode(array(struct(0 AS end, t0 AS t), struct(1 AS end, t1 AS t))) AS x"))
    asked = ends.select("id", "lag", "market", "side", "price", "moved", "x.end", (F.col("x.t") - F.col("lag") * unit).alias("at_ms"))
    at = lambda end: F.max(F.when(F.col("end") == end, F.col("ahead")))
    moves = depth_ahead_at(asked, intervals).groupBy("id", "lag").agg(F.max("moved").alias("moved"), (at(0) - at(1)).alias("predicted"))
    known = F.when(F.col("predicted").isNotNull(), F.struct(F.abs(F.col("moved") - F.col("predicted")).cast("decimal(24,6)").alias("residual"), "lag"))
    best = moves.groupBy("id").agg(F.min(known).alias("best"))
    return best.select("id", F.col("best.lag").alias("best_lag"), F.col("best.residual").alias("residual"))
