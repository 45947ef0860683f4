"""Invariants of a recording as rows: name, whether it holds, and what was counted; and the catalogue of integrity events.

All checks come from a few aggregates over the recorded tables, each of which is read once. Nothing is repaired.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Types of integrity events, and severities from the least to the worst.
TYPES = (
    "sequence_gap", "negative_level_quantity", "rest_snapshot_mismatch", "ticker_bbo_mismatch", "duplicate_trade_id", "invalid_decimal", "unexpected_schema", "db_write_failure",
    "ws_disconnect", "subscription_failure", "recovery_failure", "buffer_overflow", "partition_missing", "price_out_of_range", "crossed_book", "volume_decrease",
)
SEVERITIES = ("info", "warning", "error", "critical")
#: Types that are declared and that nothing raises.
SILENT = ("invalid_decimal", "partition_missing", "subscription_failure")
FRESH = ("ws_initial", "ws_recovery")
#: A session's first frame may be numbered so far at most.
FIRST = 2


@dataclass(frozen=True)
class Recording:
    """The recorded tables that the checks read.

    frames (session, ordinal); gaps (gap_id, status); events (type, severity); deltas (stream, market, place, applied, pre, post, delta);
    snapshots (stream, market, place, source, hash); streams (stream, session, channel, ended); sessions (session, end_reason); replays (market,
    checked, matched). ``place`` orders a market's rows; snapshots at a delta's own place precede it.
    """

    frames: DataFrame
    gaps: DataFrame
    events: DataFrame
    deltas: DataFrame
    snapshots: DataFrame
    streams: DataFrame
    sessions: DataFrame
    replays: DataFrame


def unlisted(events: DataFrame) -> DataFrame:
    """Events whose type or severity the catalogue does not have, nulls among them."""
    known = F.coalesce(F.col("type").isin(*TYPES) & F.col("severity").isin(*SEVERITIES), F.lit(False))
    return events.where(~known)


def severity_rank(severity: Column) -> Column:
    """0 for the least; null for one that is not in the catalogue."""
    return F.create_map(*[F.lit(x) for pair in zip(SEVERITIES, range(len(SEVERITIES)), strict=True) for x in pair])[severity]


def _durable(r: Recording) -> DataFrame:
    w = Window.partitionBy("session").orderBy("ordinal")
    steps = r.frames.where("ordinal IS NOT NULL").select("session", "ordinal", (F.col("ordinal") - F.lag("ordinal").over(w)).alias("step"))
    per = steps.groupBy("session").agg(F.count("*").alias("n"), F.count_if(F.col("step") != 1).alias("holes"), F.min("ordinal").alias("first"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("a"), F.coalesce(F.sum("holes"), F.lit(0)).alias("b"), F.count_if(F.col("first") > FIRST).alias("c"))


def _seeded(r: Recording) -> DataFrame:
    fresh = r.snapshots.where(F.col("source").isin(*FRESH)).select("stream", "market", "place", F.lit(0).alias("kind"))
    applied = r.deltas.where("applied").select("stream", "market", "place", F.lit(1).alias("kind"))
    w = Window.partitionBy("stream", "market").orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = applied.unionByName(fresh).withColumn("seeds", F.count_if(F.col("kind") == 0).over(w))
    bare = (F.col("kind") == 1) & (F.col("seeds") == 0)
    return rows.agg(F.count_if(F.col("kind") == 1).alias("a"), F.count_if(bare).alias("b"), F.count_distinct(F.when(bare, F.col("stream"))).alias("c"))


def soak(r: Recording) -> DataFrame:
    """(name, pass, a, b, c) of eight checks, with the counts that decide each.

    frames durable (frames, holes, sessions that begin late); gaps recovered (gaps, recovered, events of that type); deltas seeded (applied
    deltas, those before any fresh snapshot of their stream and market, streams with such); no duplicate subscriptions (streams, channels open
    twice in a session, -); arithmetic (applied deltas, exact ones, negative ones); snapshots valid (own snapshots, those without a
    hash, -); sessions closed (sessions, those without a reason, -); replay equal (states checked, matched, markets that differ).
    """
    zero = F.lit(0).cast("long")
    count = F.count("*")
    gaps = r.gaps.agg(count.alias("a"), F.count_if(F.col("status") == "recovered").alias("b")).crossJoin(r.events.agg(F.count_if(F.col("type") == "sequence_gap").alias("c")))  # one row each
    twice = r.streams.where("NOT ended").groupBy("session", "channel").agg(count.alias("n"))
    doubled = r.streams.agg(count.alias("a")).crossJoin(twice.agg(F.count_if(F.col("n") > 1).alias("b")))
    sums = r.deltas.where("applied").agg(count.alias("a"), F.count_if(F.col("post") == F.col("pre") + F.col("delta")).alias("b"), F.count_if(F.col("post") < 0).alias("c"))
    own = r.snapshots.where("source = 'local_materialized'").agg(count.alias("a"), F.count_if(F.col("hash").isNull()).alias("b"))
    closed = r.sessions.agg(count.alias("a"), F.count_if(F.col("end_reason").isNull()).alias("b"))
    total = lambda c: F.coalesce(F.sum(c), zero)
    equal = r.replays.agg(total("checked").alias("a"), total("matched").alias("b"), F.count_if(F.col("checked") != F.col("matched")).alias("c"))
    a, b, c = (F.col(x) for x in "abc")
    checks = [
        ("frames durable", _durable(r), (b == 0) & (c == 0)), ("gaps recovered", gaps, (a > 0) & (a == b) & (a == c)), ("deltas seeded", _seeded(r), b == 0), ("no duplicate subscriptions", doubled, b == 0),
        ("arithmetic", sums, (a == b) & (c == 0)), ("snapshots valid", own, b == 0), ("sessions closed", closed, (a > 1) & (b == 0)), ("replay equal", equal, (a > 0) & (a == b)),
    ]
    out = None
    for name, counted, holds in checks:
        full = counted if "c" in counted.columns else counted.withColumn("c", zero)
        row = full.select(F.lit(name).alias("name"), holds.alias("pass"), *[F.col(x).cast("long").alias(x) for x in "abc"])
        out = row if out is None else out.unionByName(row)
    return out


def deploy(r: Recording, sessions: DataFrame, capture_gaps: DataFrame) -> DataFrame:
    """(name, pass, detail) of a restart: the checks that a recording alone can answer, on the last two of ``sessions``.

    sessions (session, started, end_reason, commit, flushed); capture_gaps (started, ended). The earlier session was stopped on request, all that it
    held was written, the later one names its build, starts from fresh snapshots, and the time between is recorded as a gap.
    """
    ranked = sessions.withColumn("_r", F.row_number().over(Window.orderBy(F.col("started").desc())))  # a handful of sessions
    two = ranked.where("_r <= 2").groupBy().agg(*[F.max(F.when(F.col("_r") == k, F.struct("session", "started", "end_reason", "commit", "flushed"))).alias(name) for k, name in ((1, "new"), (2, "old"))])
    bare = r.deltas.where("applied").join(r.streams.select("stream", "session").distinct(), "stream").groupBy("session", "stream", "market").agg(F.min("place").alias("place"))
    seeds = r.snapshots.where(F.col("source").isin(*FRESH)).groupBy("stream", "market").agg(F.min("place").alias("seed"))
    late = bare.join(seeds, ["stream", "market"], "left").where("seed IS NULL OR seed > place").groupBy("session").agg(F.count("*").alias("late"))
    row = two.join(late, F.col("new.session") == F.col("session"), "left").drop("session").crossJoin(capture_gaps.agg(F.collect_set(F.struct("started", "ended")).alias("gaps")))  # one row each
    gap = F.exists("gaps", lambda g: (g["started"] >= F.col("old.started")) & (g["ended"] <= F.col("new.started")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    checks = F.array(*[F.struct(F.lit(name).alias("name"), yes(holds).alias("pass"), F.coalesce(detail.cast("string"), F.lit("none")).alias("detail")) for name, holds, detail in (
        ("stopped on request", F.col("old.end_reason") == "sigterm", F.col("old.end_reason")), ("last batch written", F.col("old.flushed"), F.col("old.flushed")), ("build recorded", F.col("new.commit").isNotNull(), F.col("new.commit")),
        ("restart is a new session", F.col("old.session").isNotNull(), F.col("new.session")), ("restart from fresh snapshots", F.coalesce("late", F.lit(0)) == 0, F.coalesce("late", F.lit(0))), ("deploy recorded as a gap", gap, F.size("gaps")),
    )])
    return row.select(F.explode(checks).alias("x")).select("x.*")
