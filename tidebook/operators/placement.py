"""Where to put probes: resting levels behind the touch as options of design cells, and a seeded choice that keeps the cells level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRICE = "decimal(12,6)"
CELL = ["series", "side", "ticks"]


def options(tops: DataFrame, levels: DataFrame, ticks: tuple[int, ...], resting: bool = True) -> DataFrame:
    """(market, series, side, ticks, price) behind the touch of valid two-sided books: tops (market, series, bid, ask), levels (market, side, price, size).

    side is ``bid`` or ``ask`` and prices are on the yes scale: ``ticks`` cents below the best bid or above the best ask, inside (0, 1) and not
    across the book. With ``resting`` only where somebody is at that price, so that there is a queue to observe.
    """
    two = tops.where("bid IS NOT NULL AND ask IS NOT NULL")
    step = F.col("ticks") / F.lit(100).cast(PRICE)
    side = F.explode(F.array(F.lit("bid"), F.lit("ask"))).alias("side")
    each = two.select("*", side).select("*", F.explode(F.array(*[F.lit(t) for t in ticks])).alias("ticks"))
    priced = each.withColumn("price", F.when(F.col("side") == "bid", F.col("bid") - step).otherwise(F.col("ask") + step).cast(PRICE))
    fits = (F.col("price") > 0) & (F.col("price") < 1) & F.when(F.col("side") == "bid", F.col("price") < F.col("ask")).otherwise(F.col("price") > F.col("bid"))
    found = priced.where(fits).select("market", *CELL, "price")
    if not resting:
        return found
    # asks rest on the no ladder, at the complement
    there = levels.where("size > 0").select("market", F.when(F.col("side") == "yes", "bid").otherwise("ask").alias("side"), F.when(F.col("side") == "yes", F.col("price")).otherwise(1 - F.col("price")).cast(PRICE).alias("price"))
    return found.join(there, ["market", "side", "price"], "left_semi").select("market", *CELL, "price")


def chosen(found: DataFrame, sampled: DataFrame, n: int, seed: str, quota: int | None = None) -> DataFrame:
    """The next ``n`` options, as if each took the least sampled cell and a random option of it that is not yet taken.

    ``sampled`` (series, side, ticks, n): probes so far. A cell's j-th pick comes when it has n + j - 1, so all picks are ordered by that number and, among
    equals, by a hash of the seed; options of a cell are taken in the order of theirs. ``quota`` bounds what a cell may reach. The same seed gives the same picks.
    """
    draw = lambda *parts: F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(p).cast("string") for p in parts]), 256)
    known = found.join(sampled.select(*CELL, F.col("n").alias("_n")), CELL, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    in_cell = Window.partitionBy(*CELL).orderBy(draw("market", *CELL), "market")
    level = known.withColumn("level", (F.col("_n") + F.row_number().over(in_cell) - 1).cast("long"))
    if quota is not None:
        level = level.where(F.col("level") < quota)
    first = level.withColumn("_tie", draw("level", *CELL)).orderBy("level", "_tie", *CELL).limit(n)  # the feature: n probes
    place = F.row_number().over(Window.orderBy("level", "_tie", *CELL))  # n rows
    return first.select("market", *CELL, "price", "level", place.alias("place"))
