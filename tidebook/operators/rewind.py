"""Recent states of a book, and a book polled from elsewhere held against them.

A book is a history of numbered states: state 0 is what a reset or a snapshot left, state n is what the n-th change made of it.
Going back is a lookup of the numbers below the current one, at most as many as a journal keeps: an equality join on (market,
epoch, n), never a scan of a range. States are compared by their marks (:mod:`tidebook.operators.ticks`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators import ticks
from tidebook.operators.temporal import asof_join

#: A journal holds the changes of the last 10 s, 2048 at most; a rewind gives 64 states at most.
JOURNAL_MS, JOURNAL_CHANGES, STATES = 10_000, 2048, 64
#: A poll may lie this far from a state that it matches; confirmed mismatches in a row that escalate.
TOLERANCE_MS, ESCALATE = 2_000, 2


def history(states: DataFrame, seeds: DataFrame) -> DataFrame:
    """(market, epoch, n, at, ms, mark, next_ms): every state of each epoch, with the instant of the change that ended it.

    ``states`` (market, epoch, at, ms, mark) holds applied changes only; ``seeds`` (market, epoch, at, ms, mark) the first states.
    """
    w = Window.partitionBy("market", "epoch").orderBy("at")
    rows = states.select("market", "epoch", "at", "ms", "mark").unionByName(seeds.select("market", "epoch", "at", "ms", "mark"))
    return rows.select("*", (F.row_number().over(w) - 1).alias("n"), F.lead("ms").over(w).alias("next_ms"))


def current(asks: DataFrame, past: DataFrame, time: str) -> DataFrame:
    """asks (ask_id, market, ...) with epoch, n, last_ms and mark of the state in force at ``time``; null before the first."""
    last = past.groupBy("market", "ms").agg(F.max_by(F.struct("epoch", "n", F.col("ms").alias("last_ms"), "mark"), "at").alias("_now"))
    found = asof_join(asks, last.withColumnRenamed("ms", time), ["market"], time, ["_now"])
    return found.select(*asks.columns, "_now.epoch", "_now.n", "_now.last_ms", "_now.mark")


def rewind(asks: DataFrame, past: DataFrame, time: str = "now_ms", since: str = "from_ms", window_ms: int = JOURNAL_MS, changes: int = JOURNAL_CHANGES, states: int = STATES) -> DataFrame:
    """(ask_id, k, at_ms, at, mark): states of the book from the one in force at ``time`` (k = 0) back, newest first.

    A change can be undone if the journal still has it - no further back than ``window_ms`` before the last change, nor than
    ``changes`` of them - and if it is not older than ``since``. No state before the last reset is reached. A state's instant is that
    of the change that made it, or, where the journal has lost that one, of the change that ended it; ``at`` is null then.
    """
    asked = current(asks.select("ask_id", "market", time, since), past, time).where("n IS NOT NULL")
    back = F.sequence(F.lit(0), F.least(F.col("n"), F.lit(min(states - 1, changes))))
    steps = asked.select("ask_id", "market", "epoch", since, "last_ms", F.col("n").alias("top"), F.explode(back).alias("k")).withColumn("n", F.col("top") - F.col("k"))
    held = past.select("market", "epoch", "n", "at", "ms", "next_ms", "mark")
    oldest = F.col("last_ms") - window_ms
    known = (F.col("n") > 0) & (F.col("ms") >= oldest) & (F.col("top") - F.col("n") < changes)
    return (
        steps.join(held, ["market", "epoch", "n"])
        .where((F.col("k") == 0) | (F.col("next_ms") >= F.greatest(F.col(since), oldest)))
        .select("ask_id", "k", F.when(known | (F.col("k") == 0), F.col("ms")).otherwise(F.col("next_ms")).alias("at_ms"),
                F.when(known | (F.col("k") == 0), F.col("at")).alias("at"), "mark")
    )


def validated(polls: DataFrame, past: DataFrame, valid: DataFrame, tolerance_ms: int = TOLERANCE_MS, escalate: int = ESCALATE, **journal: int) -> DataFrame:
    """What polls (poll_id, market, t0, t1, polled) of books that are valid at t0 say, one row each.

    ``polled`` is the mark of the levels that came at t1 on a request of t0. The book matches as it stands at t1
    (``match_current``), or as it stood at some instant since t0 less the tolerance (``match_recent``). Else the first
    mismatch of a market is ``mismatch_transient``, and the next poll's, if it does not match either, ``mismatch_confirmed``; then it starts
    again. Confirmed ones count up until the market matches, and from ``escalate`` on they escalate. ``valid`` (market, ms, ok) says from when
    on a book may be trusted.
    """
    trusted = asof_join(polls.withColumnRenamed("t0", "ms"), valid, ["market"], "ms", ["ok"]).withColumnRenamed("ms", "t0").where("ok").drop("ok")
    seen = current(trusted, past, "t1").where("n IS NOT NULL").withColumn("same", F.col("mark") == F.col("polled"))
    asks = seen.where("NOT same").select(F.col("poll_id").alias("ask_id"), "market", "t1", (F.col("t0") - tolerance_ms).alias("from_ms"))
    states = rewind(asks, past, "t1", "from_ms", **journal)
    other = seen.select(F.col("poll_id").alias("ask_id"), "polled", "t1")
    hits = states.join(other, "ask_id").groupBy(F.col("ask_id").alias("poll_id")).agg(
        F.count("*").alias("considered"),
        F.min(F.when((F.col("mark") == F.col("polled")) & (F.col("at_ms") <= F.col("t1") + tolerance_ms), F.struct("k", "at_ms", "at"))).alias("hit"),
    )
    judged = seen.join(hits, "poll_id", "left").withColumn("agrees", F.col("same") | F.col("hit").isNotNull())
    order = Window.partitionBy("market").orderBy("t1", "poll_id").rowsBetween(Window.unboundedPreceding, 0)
    runs = judged.withColumn("run", F.count_if("agrees").over(order))
    inside = Window.partitionBy("market", "run").orderBy("t1", "poll_id").rowsBetween(Window.unboundedPreceding, 0)
    streaks = runs.withColumn("nth", F.count_if(~F.col("agrees")).over(inside))
    kind = (
        F.when(F.col("same"), "match_current").when(F.col("agrees"), "match_recent")
        .when(F.col("nth") % 2 == 1, "mismatch_transient").otherwise("mismatch_confirmed")
    )
    confirmed = F.when(kind == "mismatch_confirmed", (F.col("nth") / 2).cast("long"))
    return streaks.select(
        "poll_id", "market", "t0", "t1", "epoch", "n", kind.alias("kind"), F.col("hit.at_ms").alias("matched_at_ms"), F.col("hit.at").alias("matched_at"),
        F.coalesce("considered", F.lit(1)).cast("long").alias("states_considered"), confirmed.alias("consecutive_confirmed"),
        F.coalesce(confirmed >= escalate, F.lit(False)).alias("escalate"),
    )


def level_differences(asks: DataFrame, levels: DataFrame, polled: DataFrame) -> DataFrame:
    """(ask_id, side, price, local, other) where the local book and a polled one differ, either side null where it has no such level.

    ``asks`` (ask_id, market, epoch, n); ``levels`` (market, epoch, side, price, size, from_n, to_n) are a level's sizes by state
    numbers, to_n exclusive or null; ``polled`` (ask_id, side, price, size).
    """
    here = asks.join(levels, ["market", "epoch"]).where("n >= from_n AND (to_n IS NULL OR n < to_n) AND size > 0")
    local = here.select("ask_id", "side", "price", F.col("size").alias("local"))
    other = polled.join(asks.select("ask_id"), "ask_id").where("size > 0").select("ask_id", "side", "price", F.col("size").alias("other"))
    return local.join(other, ["ask_id", "side", "price"], "full").where("NOT local <=> other")


def first_states(resets: DataFrame) -> DataFrame:
    """(market, epoch, at, ms, mark) of resets (market, at, ms) that leave an empty book; epochs are numbered from 1."""
    epoch = F.row_number().over(Window.partitionBy("market").orderBy("at"))
    return resets.select("market", epoch.cast("long").alias("epoch"), "at", "ms", F.expr(ticks.EMPTY).alias("mark"))
