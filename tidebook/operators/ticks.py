"""A book after every event as running aggregates: occupied ticks as bits, states as fingerprints. No row is folded.

A ladder is a set of occupied ticks. An event flips at most one of them, so a running ``bit_xor`` of the flips is the
ladder after each event, and the best price is its highest bit. In the same way a running ``bit_xor`` over hashes of
(side, price, size) that come and go names the whole state: equal books have equal marks, however they came about.
All of it is windows over columns inside the JVM; where one key holds too many rows for a task, its rows are cut into blocks
whose totals are summed apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ticks in one word of a ladder's bits: a long without its sign.
WORD = 62
PRICE, SIZE = "decimal(12,6)", "decimal(24,6)"


def running(rows: DataFrame, by: list[str], at: str, columns: dict[str, tuple[str, Column]], block: Column | None = None) -> DataFrame:
    """rows with running aggregates: name -> (``sum``, ``max`` or ``bit_xor``, column), up to and with all rows of the same ``at``.

    With ``block``, which never falls as ``at`` grows, no task holds more of a key than a block's rows: totals of the blocks before are
    running aggregates over one row a block.
    """
    fold = {"sum": F.sum, "max": F.max, "bit_xor": F.bit_xor}
    if block is None:
        w = Window.partitionBy(*by).orderBy(at)
        return rows.select("*", *[fold[kind](c).over(w).alias(name) for name, (kind, c) in columns.items()])
    cut = rows.select("*", block.alias("_block"), *[c.alias(f"_in_{name}") for name, (_, c) in columns.items()])
    own = Window.partitionBy(*by, "_block").orderBy(at)
    inside = cut.select("*", *[fold[kind](f"_in_{name}").over(own).alias(name) for name, (kind, _) in columns.items()])
    totals = cut.groupBy(*by, "_block").agg(*[fold[kind](f"_in_{name}").alias(f"_all_{name}") for name, (kind, _) in columns.items()])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_block").alias("_kb"),
                            *[fold[kind](f"_all_{name}").over(before).alias(f"_all_{name}") for name, (kind, _) in columns.items()])
    same = F.col("_block") == F.col("_kb")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    both = {"sum": lambda a, b: a + b, "max": F.greatest, "bit_xor": lambda a, b: a.bitwiseXOR(b)}

    def joined(name: str, kind: str) -> Column:
        a, b = F.col(name), F.col(f"_all_{name}")
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both[kind](a, b)).alias(name)

    return inside.join(carried, same).select(*rows.columns, *[joined(name, kind) for name, (kind, _) in columns.items()])


def level_marks(side: Column, price: Column, size: Column) -> tuple[Column, Column]:
    """Two hashes of a level that holds something; of an empty one, nought."""
    p, s = price.cast(PRICE), size.cast(SIZE)
    return tuple(F.when(s > 0, F.xxhash64(F.lit(seed), side, p, s)).otherwise(F.lit(0).cast("long")) for seed in (1, 2))


def book_marks(levels: DataFrame, by: list[str], side: str = "side", price: str = "price", size: str = "size") -> DataFrame:
    """(by, mark, levels): the state that a table of levels (at most one row for each side and price) makes up."""
    a, b = level_marks(F.col(side), F.col(price), F.col(size))
    grouped = levels.groupBy(*by).agg(F.bit_xor(a).alias("_a"), F.bit_xor(b).alias("_b"), F.count_if(F.col(size) > 0).alias("levels"))
    return grouped.select(*by, F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")).alias("mark"), "levels")


#: The mark of an empty book.
EMPTY = "named_struct('a', CAST(0 AS BIGINT), 'b', CAST(0 AS BIGINT))"


def after_each(changes: DataFrame, by: list[str], at: str, tick: str = "0.01", ticks: int = 100, sizes: bool = True, block: Column | None = None) -> DataFrame:
    """changes (by, at, side, price, pre, post) with the book after each: bid, ask, their sizes, levels of both sides and mark.

    ``pre`` and ``post`` are a level's sizes before and after, null (as is ``side``) in rows that change nothing. Asks are complements of
    the no side. A price that is no multiple of ``tick``, or beyond ``ticks`` of them, is an error, not a wrong answer.
    """
    n_words = -(-ticks // WORD)
    place = F.col("price") / F.lit(tick).cast(PRICE)
    index = place.cast("int") - 1
    fits = (index >= 0) & (index < n_words * WORD) & (place == place.cast("int"))
    checked = F.when(F.col("side").isNull() | fits, index).otherwise(F.raise_error(F.concat(F.lit("price off the ticks: "), F.col("price").cast("string"))))
    flips = F.col("side").isNotNull() & ((F.coalesce("pre", F.lit(0)) > 0) != (F.coalesce("post", F.lit(0)) > 0))
    zero = F.lit(0).cast("long")
    rows = changes.select("*", F.when(flips, checked).alias("_i"))
    columns: dict[str, tuple[str, Column]] = {}
    for side in ("yes", "no"):
        for k in range(n_words):
            here = (F.col("side") == side) & F.col("_i").between(k * WORD, (k + 1) * WORD - 1)
            columns[f"_{side}{k}"] = ("bit_xor", F.when(here, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_i") - k * WORD)).otherwise(zero))
    for k, (old, new) in enumerate(zip(level_marks(F.col("side"), F.col("price"), F.coalesce("pre", F.lit(0))), level_marks(F.col("side"), F.col("price"), F.coalesce("post", F.lit(0))), strict=True)):
        columns[f"_m{k}"] = ("bit_xor", F.when(F.col("side").isNull(), zero).otherwise(old.bitwiseXOR(new)))
    found = running(rows, by, at, columns, block)

    def best(side: str) -> Column:
        top = F.lit(None).cast("int")
        for k in range(n_words):  # higher words overrule
            word = F.col(f"_{side}{k}")
            top = F.when(word != 0, F.lit(k * WORD) + F.length(F.bin(word))).otherwise(top)
        return (top * F.lit(tick).cast(PRICE)).cast(PRICE)

    count = lambda side: sum((F.bit_count(f"_{side}{k}") for k in range(1, n_words)), F.bit_count(f"_{side}0")).cast("int")
    kept = found.select(
        *changes.columns, best("yes").alias("bid"), best("no").alias("_no"), count("yes").alias("yes_levels"), count("no").alias("no_levels"),
        F.struct(F.col("_m0").alias("a"), F.col("_m1").alias("b")).alias("mark"),
    )
    priced = kept.withColumn("ask", (1 - F.col("_no")).cast(PRICE))
    if not sizes:
        return priced.drop("_no")
    return _with_sizes(_with_sizes(priced, by, at, "yes", "bid", "bid_size"), by, at, "no", "_no", "ask_size").drop("_no")


def _with_sizes(rows: DataFrame, by: list[str], at: str, side: str, price: str, out: str) -> DataFrame:
    """rows with the size at ``price`` of ``side`` after each: the level's last statement, by one window over what is asked and what is stated.

    A row asks for its best price and states its own level, so both come from the same rows and nothing before is computed twice.
    """
    part = lambda asked, p, size: F.struct(F.lit(asked).alias("asked"), p.alias("p"), size.alias("size"))
    asks, states = part(1, F.col(price), F.lit(None).cast(SIZE)), part(0, F.col("price").cast(PRICE), F.col("post").cast(SIZE))
    both = F.when(F.col("side") == side, F.array(states, asks)).otherwise(F.array(asks))
    found = rows.select("*", F.explode(both).alias("_x"))
    w = Window.partitionBy(*by, F.col("_x.p")).orderBy(at, F.col("_x.asked")).rowsBetween(Window.unboundedPreceding, 0)
    last = found.withColumn(out, F.last("_x.size", ignorenulls=True).over(w)).where("_x.asked = 1")
    return last.withColumn(out, F.when(F.col(price).isNotNull(), F.col(out))).drop("_x")
