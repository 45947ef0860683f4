"""Replay of order books event by event: what each delta did, the best prices after it, and state hashes.

:func:`states` is windows over columns (:mod:`tidebook.operators.ticks`). Only state hashes need the whole book's text, which
:func:`hashed` folds: a book is empty at a reset and independent of what was before, so epochs are dealt over all tasks and
each task folds its sorted rows as they stream by, with one book in hand. Sizes and prices are exact integers of a millionth there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators import ticks

ROWS = (
    "market long, epoch long, event_id long, ms long, applied boolean, pre long, post long, level_action string, error string, "
    "bid long, bid_size long, ask long, ask_size long, hash string"
)
PRICE, SIZE = "decimal(12,6)", "decimal(24,6)"


def _text(micros: int) -> str:
    return f"{micros // 1_000_000}.{micros % 1_000_000:06d}"


def book_text(market: int, yes: dict, no: dict) -> str:
    """Fixed format: what a book's hash is taken of."""
    ladder = lambda levels: ",".join(f"{_text(p)}@{_text(levels[p])}" for p in sorted(levels, reverse=True))
    return f"{market}\nyes:{ladder(yes)}\nno:{ladder(no)}"


def states(applied: DataFrame, block: Column | None = None) -> DataFrame:
    """One row for each delta (market, epoch, event_id, ms, side, price, delta, post, ok, cut): what it did, and the book after it.

    ``post`` is the level's running size and ``cut`` the epoch's first event that makes one negative: that one is not applied and
    invalidates the book, its action is ``unknown``, and until the next reset nothing is applied and there are no best prices.
    """
    reached = F.col("ok") | (F.col("event_id") == F.col("cut"))
    pre = (F.col("post") - F.col("delta")).cast(SIZE)
    action = (
        F.when(~F.col("ok"), "unknown").when(F.col("post") == 0, "delete").when(F.col("pre") == 0, "insert")
        .when(F.col("delta") > 0, "increase").when(F.col("delta") == 0, "unknown").otherwise("decrease")
    )
    rows = applied.select("market", "epoch", "event_id", "ms", "ok", "delta", F.when(F.col("ok"), F.col("side")).alias("side"), "price",
                          F.when(reached, pre).alias("pre"), F.when(reached, F.col("post")).alias("post"), reached.alias("_reached"))
    found = ticks.after_each(rows, ["market", "epoch"], "event_id", block=block)
    valid = lambda *names: [F.when(F.col("ok"), F.col(c)).alias(c) for c in names]
    error = F.when(F.col("ok"), None).when(F.col("_reached"), "negative level").otherwise("book invalid")
    return found.select(
        "market", "epoch", "event_id", "ms", F.col("ok").alias("applied"), "pre", "post", F.when(F.col("_reached"), action).alias("level_action"),
        error.alias("error"), *valid("bid", "bid_size", "ask", "ask_size", "mark", "yes_levels", "no_levels"),
    )


def hashed(deltas: DataFrame, hash_every: int) -> DataFrame:
    """One row for each delta (market, epoch, event_id, ms, side, price, delta), as :func:`states` has them, by a fold.

    The valid book's SHA-256 stands at every event whose id ``hash_every`` divides.
    """

    def fold(batches):
        import hashlib

        import pandas as pd

        names, wide = [c.split()[0] for c in ROWS.split(", ")], ("pre", "post", "bid", "bid_size", "ask", "ask_size")
        epoch_of, valid, book = None, True, {"yes": {}, "no": {}}
        for batch in batches:
            out = []
            for market, epoch, event, ms, side, price, delta in zip(*[batch[c].tolist() for c in ("market", "epoch", "event_id", "ms", "side", "p", "d")], strict=True):
                if epoch_of != (market, epoch):
                    epoch_of, valid, book = (market, epoch), True, {"yes": {}, "no": {}}
                if not valid:
                    out.append((market, epoch, event, ms, False, None, None, None, "book invalid", None, None, None, None, None))
                    continue
                levels = book[side]
                pre = levels.get(price, 0)
                post = pre + delta
                if post < 0:
                    valid = False
                    out.append((market, epoch, event, ms, False, pre, post, "unknown", "negative level", None, None, None, None, None))
                    continue
                action = "delete" if post == 0 else "insert" if pre == 0 else "increase" if delta > 0 else "unknown" if delta == 0 else "decrease"
                if post:
                    levels[price] = post
                else:
                    levels.pop(price, None)
                yes, no = (max(book[s], default=None) for s in ("yes", "no"))
                digest = hashlib.sha256(book_text(market, book["yes"], book["no"]).encode()).hexdigest() if event % hash_every == 0 else None
                out.append((market, epoch, event, ms, True, pre, post, action, None, yes, book["yes"].get(yes), None if no is None else 1_000_000 - no, book["no"].get(no), digest))
            yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in wide})

    micros = lambda c: (F.col(c) * 1_000_000).cast("long")
    packed = deltas.select("market", "epoch", "event_id", "ms", "side", micros("price").alias("p"), micros("delta").alias("d"))
    tasks = int(deltas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = packed.repartition(tasks, "market", "epoch").sortWithinPartitions("market", "epoch", "event_id").mapInPandas(fold, ROWS)
    back = lambda c, kind: (F.col(c).cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast(kind).alias(c)
    return found.select(
        "market", "epoch", "event_id", "ms", "applied", back("pre", SIZE), back("post", SIZE), "level_action", "error",
        back("bid", PRICE), back("bid_size", SIZE), back("ask", PRICE), back("ask_size", SIZE), "hash",
    )


def mid(bid: Column, ask: Column) -> Column:
    return ((bid + ask) / 2).cast(PRICE)


def microprice(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    f = lambda c: c.cast("double")
    return F.round((f(bid) * f(ask_size) + f(ask) * f(bid_size)) / (f(bid_size) + f(ask_size)), 6)


def mid_series(found: DataFrame, resets: DataFrame) -> DataFrame:
    """(market, ms, mid, micro, bid, ask, bid_size, ask_size): change points only, the last state of a millisecond.

    An unknown mid - one side empty, the book invalid or reset - is stated, so that a later lookup does not skip it.
    """
    tops = ["bid", "ask", "bid_size", "ask_size"]
    rows = found.select("market", "ms", "event_id", *tops).unionByName(resets.select("market", "ms", "event_id"), allowMissingColumns=True)
    last = rows.groupBy("market", "ms").agg(*[F.max_by(F.struct(*tops), "event_id").alias("s")]).select("market", "ms", "s.*")
    priced = last.select("*", mid(F.col("bid"), F.col("ask")).alias("mid"), microprice(*[F.col(c) for c in ("bid", "bid_size", "ask", "ask_size")]).alias("micro"))
    before = Window.partitionBy("market").orderBy("ms")
    was = priced.withColumn("was", F.lag(F.struct("mid", "micro")).over(before))
    return was.where("was IS NULL OR NOT (was.mid <=> mid AND was.micro <=> micro)").drop("was")


def throttled(rows: DataFrame, key: str, at: str, cooldown: int) -> DataFrame:
    """(key, at): of each key's instants those that lie ``cooldown`` or more after the last one kept, the first included."""
    step = f"(a, t) -> CASE WHEN size(a) = 0 OR t >= element_at(a, -1) + {cooldown} THEN concat(a, array(t)) ELSE a END"
    gathered = rows.groupBy(key).agg(F.array_sort(F.collect_set(at)).alias("ts"))  # distinct instants of one key
    return gathered.select(key, F.explode(F.expr(f"aggregate(ts, CAST(array() AS array<bigint>), {step})")).alias(at))
