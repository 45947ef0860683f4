"""Replay of books from stored snapshots: seeds that carry levels, skipped positions, re-seeding, a bound, warnings as rows.

A snapshot opens a segment and states its levels; a delta belongs to the segment of the last snapshot before it. Inside a segment every
level is a running sum, so a replay is windows over all requests, markets and segments at once, and starting late costs no more
than starting at the beginning. Positions are (ms, start of the stream, stream, sequence number): numbers restart with each
stream, and instants do not fall from one stream of a market to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators import ticks
from tidebook.storage import stage_table, unstage

#: Snapshots that may open a replay, and those that take over in its course.
OPENING = ("ws_initial", "ws_recovery", "session_handoff", "local_materialized")
TAKING_OVER = ("ws_initial", "ws_recovery", "session_handoff")
ASK = ["request_id", "market", "from_ms", "to_ms", "to_stream", "to_seq"]


def _place(kind: int) -> Column:
    return F.struct("ms", "started_ms", "stream", "seq", F.lit(kind).alias("kind"))


def opening_seeds(requests: DataFrame, seeds: DataFrame) -> DataFrame:
    """requests with the snapshot that opens each: the last at or before ``from_ms``, else the first up to ``to_ms``, else null."""
    own = seeds.where(F.col("source").isin(*OPENING)).select("market", "snapshot_id", _place(0).alias("place"))
    both = requests.join(own, "market", "left")
    early, late = F.col("place.ms") <= F.col("from_ms"), F.col("place.ms").between(F.col("from_ms") + 1, F.col("to_ms"))
    seed = F.struct("place", "snapshot_id")
    found = both.groupBy(*ASK).agg(F.max(F.when(early, seed)).alias("_a"), F.min(F.when(late, seed)).alias("_b"))
    return found.select(*ASK, F.coalesce("_a", "_b").alias("seed"), F.when(F.col("_a").isNull(), F.when(F.col("_b").isNull(), "no seed").otherwise("late seed")).alias("warning"))


def _bounded(moves: DataFrame) -> DataFrame:
    """moves up to each request's bound: the first delta past (to_stream, to_seq), or on another stream once that one was met."""
    w = Window.partitionBy("request_id")
    on = F.col("to_stream").isNull() | (F.col("stream") == F.col("to_stream"))
    delta = F.col("place.kind") == 1
    met = F.min(F.when(delta & on, F.col("place"))).over(w)
    past = delta & F.col("to_seq").isNotNull() & ((on & (F.col("seq") > F.col("to_seq"))) | (~on & (F.col("place") > F.col("_met"))))
    cut = moves.withColumn("_met", met).withColumn("_stop", F.min(F.when(past, F.col("place"))).over(w))
    kept = cut.where("_stop IS NULL OR place < _stop")
    last = F.max(F.when(F.col("place.kind") == 1, F.col("place"))).over(w)
    # where a bound stopped the replay, no snapshot after its last delta is taken; the opening one always is
    return kept.withColumn("_last", last).where("_stop IS NULL OR opens OR place <= _last").drop("_met", "_stop", "_last")


def _steps(requests: DataFrame, seeds: DataFrame, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Opened requests, and the snapshots and deltas of each in their order, with the segment that each belongs to."""
    opened = opening_seeds(requests, seeds)
    ready = opened.where("seed IS NOT NULL")
    taking = F.col("source").isin(*TAKING_OVER) & (F.col("ms") > F.col("seed.place.ms")) & (F.col("ms") <= F.col("to_ms"))
    first = F.col("snapshot_id") == F.col("seed.snapshot_id")
    heads = ready.join(seeds.select("market", "snapshot_id", "source", "ms", "started_ms", "stream", "seq", _place(0).alias("place")), "market").where(first | taking)
    heads = heads.withColumn("opens", F.coalesce(first, F.lit(False)))
    rows = ready.join(deltas.select("*", _place(1).alias("place")), "market").where("ms BETWEEN seed.place.ms AND to_ms AND place > seed.place")
    # a delta that has the opening snapshot's own number is part of it
    rows = rows.where("NOT (stream <=> seed.place.stream AND seq <= seed.place.seq)").withColumn("opens", F.lit(False))
    moves = _bounded(heads.drop("seed", "warning").unionByName(rows.drop("seed", "warning"), allowMissingColumns=True))
    w = Window.partitionBy("request_id").orderBy("place")
    return opened, moves.select("*", F.count_if(F.col("place.kind") == 0).over(w).alias("segment"))


def _diverged(steps: DataFrame) -> DataFrame:
    """steps (request_id, segment, place, side, price, delta) with pre, post and whether the delta would make its level negative.

    Such a delta is left out and the level goes on from where it was. Levels where that happens are gone through again,
    one such delta of each at a time, until none is left; all others are done with the first pass.
    """
    level = ["request_id", "segment", "side", "price"]
    w, whole = Window.partitionBy(*level).orderBy("place"), Window.partitionBy(*level)
    done, left = [], steps.withColumn("bad", F.lit(False))
    used: list[DataFrame] = []
    while True:
        post = F.sum(F.when(~F.col("bad"), F.col("delta")).otherwise(0)).over(w).cast(ticks.SIZE)
        run = left.withColumn("post", post).withColumn("_cut", F.min(F.when(F.col("post") < 0, F.col("place"))).over(whole))
        run = stage_table(run, "levels")
        used.append(run)
        done.append(run.where("_cut IS NULL"))
        left = run.where("_cut IS NOT NULL")
        if left.isEmpty():
            break
        left = left.withColumn("bad", F.col("bad") | (F.col("place") == F.col("_cut"))).drop("post", "_cut")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    kept = stage_table(out.drop("_cut").withColumn("pre", F.when(F.col("bad"), F.col("post")).otherwise(F.col("post") - F.col("delta")).cast(ticks.SIZE)), "levels")
    unstage(*used)
    return kept


def replayed(requests: DataFrame, seeds: DataFrame, levels: DataFrame, deltas: DataFrame, strict: bool = False, unapplied: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, epochs, warnings) of requests (request_id, market, from_ms, to_ms, to_stream, to_seq).

    seeds: snapshot_id, market, ms, started_ms, stream, seq, source; levels: snapshot_id, side, price, size; deltas: delta_id, market, ms,
    started_ms, stream, seq, side, price, delta, applied. A delta recorded as not applied is not applied here.

    Frames are the book after every snapshot and applied delta from ``from_ms`` on; after a delta that makes a level negative the
    book is not valid until the next snapshot, and with ``strict`` the replay ends there. Epochs are runs of snapshots of one stream, a hand-off
    always beginning one, with deltas applied and skipped and recoveries met. Warnings: ``late seed``, ``no seed``, ``diverged`` and, with
    ``strict`` (up to where the replay ends) or ``unapplied`` (over the whole of it), ``not applied``.
    """
    opened, moves = _steps(requests, seeds, deltas)
    # a written table: the frames, epochs and warnings read it, and so does each pass over levels that diverge
    steps = stage_table(moves.drop("from_ms", "to_ms", "to_stream", "to_seq").join(opened.select("request_id", "from_ms"), "request_id"), "steps")
    heads = steps.where("place.kind = 0")
    stated = heads.join(levels, "snapshot_id").select("request_id", "segment", "place", levels["side"], levels["price"], levels["size"].alias("delta"), F.lit(True).alias("stated"))
    moved = steps.where("place.kind = 1 AND applied").select("request_id", "segment", "place", "side", "price", "delta", F.lit(False).alias("stated"), "delta_id")
    sized = _diverged(stated.unionByName(moved, allowMissingColumns=True))
    if strict:
        ends = stage_table(sized.where("bad").groupBy("request_id").agg(F.min("place").alias("_end")), "ends")
        upto = lambda rows: rows.join(ends, "request_id", "left").where("_end IS NULL OR place <= _end").drop("_end")
        steps, heads, sized = upto(steps), upto(heads), upto(sized)
    marks = heads.select("request_id", "segment", "place").withColumn("head", F.lit(True))
    book = ticks.after_each(sized.unionByName(marks, allowMissingColumns=True), ["request_id", "segment"], "place")
    broken = Window.partitionBy("request_id", "segment").orderBy("place")
    seen = book.where("head OR NOT stated").withColumn("valid", F.count_if("bad").over(broken) == 0)
    asked = opened.select("request_id", "from_ms")
    frames = seen.where("NOT coalesce(bad, false)").join(asked, "request_id").where("place.ms >= from_ms").select(
        "request_id", "segment", F.col("place.ms").alias("ms"), F.col("place.stream").alias("stream"), F.col("place.seq").alias("seq"), F.coalesce("head", F.lit(False)).alias("seed"),
        "valid", "bid", "bid_size", "ask", "ask_size", "yes_levels", "no_levels", "mark",
    )
    in_order = Window.partitionBy("request_id").orderBy("place")
    turns = heads.withColumn("_was", F.lag("stream").over(in_order)).withColumn("_new", F.col("opens") | ~F.col("stream").eqNullSafe(F.col("_was")) | (F.col("source") == "session_handoff"))
    epochs = turns.withColumn("epoch", F.count_if("_new").over(in_order))
    skipped = sized.where("bad").select("request_id", "place", F.lit(True).alias("bad"))
    fate = steps.where("place.kind = 1").join(skipped, ["request_id", "place"], "left")
    counted = fate.groupBy("request_id", "segment").agg(F.count_if(F.col("applied") & F.col("bad").isNull()).alias("used"), F.count_if(~F.col("applied") | F.col("bad").isNotNull()).alias("unused"))
    by_epoch = epochs.join(counted, ["request_id", "segment"], "left").groupBy("request_id", "epoch").agg(
        F.min("place.ms").alias("started_ms"), F.min_by("snapshot_id", "place").alias("snapshot_id"), F.sum(F.coalesce("used", F.lit(0))).alias("deltas_applied"),
        F.sum(F.coalesce("unused", F.lit(0))).alias("deltas_skipped"), F.count_if((F.col("source") == "ws_recovery") & ~F.col("opens")).alias("gaps"),
    )
    said = opened.where("warning IS NOT NULL").select("request_id", "warning", F.lit(None).cast("long").alias("delta_id"))
    said = said.unionByName(sized.where("bad").select("request_id", F.lit("diverged").alias("warning"), "delta_id"))
    if strict or unapplied:
        said = said.unionByName(steps.where("place.kind = 1 AND NOT applied").select("request_id", F.lit("not applied").alias("warning"), "delta_id"))
    return frames, by_epoch, said
