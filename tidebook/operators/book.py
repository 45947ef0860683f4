"""Order books as relations: level states, best prices on a clock grid, depth and state hashes.

A level's size holds from the delta that set it until the next one at that level, or until a reset or a violation
of its epoch. A book at an instant is the set of level intervals that cover it: no state is folded row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def level_intervals(applied: DataFrame, resets: DataFrame) -> DataFrame:
    """(market, side, price, size, from_ms, to_ms) of positive sizes; to_ms is exclusive, null at the end."""
    level = Window.partitionBy("market", "epoch", "side", "price").orderBy("event_id")
    # the epoch is the number of resets so far, so the one that ends it has the next number
    ends = resets.selectExpr("market", "row_number() OVER (PARTITION BY market ORDER BY event_id) - 1 AS epoch", "ms AS reset_ms")
    cuts = applied.where("cut = event_id").selectExpr("market", "epoch", "ms AS cut_ms")
    ok = applied.where("ok").withColumn("next_ms", F.lead("ms").over(level))
    joined = ok.join(ends, ["market", "epoch"], "left").join(cuts, ["market", "epoch"], "left")
    stop = F.coalesce("next_ms", "cut_ms", "reset_ms")
    return joined.where("post > 0").select("market", "side", "price", F.col("post").alias("size"), F.col("ms").alias("from_ms"), stop.alias("to_ms"))


def on_grid(intervals: DataFrame, step: int, last_ms: int) -> DataFrame:
    """intervals once for every grid instant in [from_ms, to_ms)."""
    start = F.ceil(F.col("from_ms") / step).cast("long") * step
    stop = F.floor((F.coalesce("to_ms", F.lit(last_ms + 1)) - 1) / step).cast("long") * step
    return intervals.withColumn("bucket_ms", F.explode(F.when(start <= stop, F.sequence(start, stop, F.lit(step).cast("long")))))


def best_prices(levels: DataFrame, depth: int = 3) -> DataFrame:
    """Per market and instant: best bid and ask, spread, mid, and imbalance over the first ``depth`` levels.

    Asks are the complement of the no side. One-sided books have null ask or bid, spread and mid.
    """
    sided = levels.groupBy("market", "bucket_ms", "side").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("price", "size")), asc=False), 1, depth).alias("top")
    )
    both = sided.groupBy("market", "bucket_ms").agg(
        F.max(F.when(F.col("side") == "yes", F.col("top"))).alias("y"), F.max(F.when(F.col("side") == "no", F.col("top"))).alias("n")
    )
    total = lambda c: F.expr(f"aggregate({c}, CAST(0 AS DECIMAL(24,6)), (a, x) -> CAST(a + x.size AS DECIMAL(24,6)))")
    return both.select(
        "market", "bucket_ms",
        F.expr("y[0].price").alias("bid"),
        F.expr("CAST(1 - n[0].price AS DECIMAL(12,6))").alias("ask"),
        F.expr("CAST(1 - n[0].price - y[0].price AS DECIMAL(12,6))").alias("spread"),
        total("y").alias("bid_depth"), total("n").alias("ask_depth"),
    )


def features(levels: DataFrame, depths: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per market and instant: mid, microprice, and for each k the sizes of the best k levels and their imbalance.

    A market has at most one row per price and side, so a book's ladder is bounded by the tick grid. Mid, microprice
    and imbalance of one-sided books are null.
    """
    best = Window.partitionBy("market", "bucket_ms", "side").orderBy(F.col("price").desc())
    ranked = levels.withColumn("r", F.row_number().over(best))
    size = lambda side, k: F.sum(F.when((F.col("side") == side) & (F.col("r") <= k), F.col("size"))).cast("decimal(24,6)")
    top = lambda side: F.max(F.when((F.col("side") == side) & (F.col("r") == 1), F.col("price")))
    sums = [size(side, k).alias(f"{side}_{k}") for k in depths for side in ("yes", "no")]
    book = ranked.groupBy("market", "bucket_ms").agg(top("yes").alias("bid"), (1 - top("no")).cast("decimal(12,6)").alias("ask"), *sums)
    as_float = lambda c: F.col(c).cast("double")
    ratio = [F.round((as_float(f"yes_{k}") - as_float(f"no_{k}")) / (as_float(f"yes_{k}") + as_float(f"no_{k}")), 6).alias(f"imbalance_{k}") for k in depths]
    micro = (as_float("bid") * as_float("no_1") + as_float("ask") * as_float("yes_1")) / (as_float("yes_1") + as_float("no_1"))
    return book.select("market", "bucket_ms", F.round((as_float("bid") + as_float("ask")) / 2, 6).alias("mid"), F.round(micro, 6).alias("microprice"), *ratio)


def state_hash(levels: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of each book: key, then the yes and no ladders, price descending, as ``price@size``."""
    def ladder(side: str):
        rows = F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("price", "size"))), asc=False)
        return F.array_join(F.transform(rows, lambda x: F.concat(x["price"].cast("string"), F.lit("@"), x["size"].cast("string"))), ",")

    folded = levels.groupBy(*keys).agg(ladder("yes").alias("y"), ladder("no").alias("n"))
    text = F.concat(F.col(keys[0]).cast("string"), F.lit("\nyes:"), "y", F.lit("\nno:"), "n")
    return folded.select(*keys, F.sha2(text, 256).alias("hash"))


def ladder_hash(members: DataFrame, keys: list[str], member: str) -> DataFrame:
    """SHA-256 over the ``member=hash`` lines of each cross-section, members in order as texts; a missing hash is spelled ``null``."""
    name = F.col(member).cast("string")
    line = F.struct(name.alias("member"), F.concat(name, F.lit("="), F.coalesce("hash", F.lit("null"))).alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"])
    return members.groupBy(*keys).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"), F.count("*").alias("members"))
