"""Queries of stateful streams with timers and of streams that fill several tables, with oracles over the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.plans.books import _shipped
from tidebook.storage import shared_dir
from tidebook.streaming import flows, sinks, timed

DAY, HOUR = 86_400_000, 3_600_000
#: Markets of a stream; how long an episode may take; steps of the sampling clock.
STREAMS, TIMEOUT, STEP = 5, 12 * HOUR, 2 * DAY

#: Of a stream: errors are gaps that touch the market and its two neighbours, signups requests, purchases snapshots, some clicks its end.
_KIND = """CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'gap' WHEN event_type = 'signup' THEN 'request' WHEN event_type IN ('purchase', 'view') THEN 'snapshot'
    WHEN event_id % 41 = 0 THEN 'end' WHEN event_id % 43 = 0 THEN 'unavailable' ELSE 'frame' END"""


def stream_recoveries(spark: SparkSession, d: str) -> DataFrame:
    """Recovery episodes of streams of several markets, with timeouts by the stream's own clock."""
    _shipped()
    frames = flows.events(spark, f"{d}/events.parquet").selectExpr(
        f"user_id div {STREAMS} AS stream", "event_id AS ordinal", "at", f"{_KIND} AS kind", "user_id AS market",
        f"filter(array(user_id, user_id + 1, user_id - 1), m -> m div {STREAMS} = user_id div {STREAMS} AND m >= 0) AS affected",
    )
    return flows.drained(timed.episodes(timed.marked(frames), TIMEOUT), "append")


def stream_samples(spark: SparkSession, d: str) -> DataFrame:
    """Books on a two-day clock, sampled by timers; which of the samples is written as a snapshot."""
    _shipped()
    frames = flows.events(spark, f"{d}/events.parquet").selectExpr(
        "user_id AS market", "event_id AS ordinal", "at", "CASE event_type WHEN 'error' THEN 'reset' WHEN 'purchase' THEN 'none' ELSE 'delta' END AS kind", "CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS side",
        "(event_id * 7 % 45 + 3) * 10000 AS price", "CAST(CASE WHEN event_type = 'signup' THEN -least(round(value, 2), 4) ELSE round(value, 2) END * 100 + 0.5 * sign(CASE WHEN event_type = 'signup' THEN -1 ELSE 1 END) AS BIGINT) * 10000 AS delta",
    )
    out = flows.drained(timed.samples(timed.marked(frames).where("kind <> 'none'"), STEP), "append")
    dec = lambda c, kind: (F.col(c).cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast(kind).alias(c)
    return out.select("market", "bucket_ms", "valid", dec("bid", "decimal(12,6)"), dec("bid_size", "decimal(24,6)"), dec("ask", "decimal(12,6)"), dec("ask_size", "decimal(24,6)"), "levels", "written")


#: Raw frames, and what each kind of them becomes; every 50th delta repeats the number of the one before.
TABLES = [
    sinks.Table("trades", lambda f: f.where("event_type = 'purchase'").selectExpr("event_id AS ordinal", "event_id div 3 AS trade_id", "user_id AS market", "CAST(round(value, 2) AS DECIMAL(24,6)) AS size"), ("trade_id",), parent="raw"),
    sinks.Table("deltas", lambda f: f.where("event_type IN ('view', 'click', 'signup')").selectExpr("event_id AS ordinal", "user_id AS market", "event_id - CAST(event_id % 50 = 0 AS INT) AS seq", "CAST(round(value, 2) AS DECIMAL(24,6)) AS size"), ("market", "seq"), parent="raw"),
    sinks.Table("gaps", lambda f: f.where("event_type = 'error'").selectExpr("event_id AS ordinal", "user_id AS market"), parent="raw"),
    sinks.Table("raw", lambda f: f.selectExpr("event_id AS ordinal", "user_id AS market", "event_type", "sha2(concat(event_id, event_type, props), 256) AS payload_hash")),
]


def stream_tables(spark: SparkSession, d: str) -> DataFrame:
    """Four tables from one stream: rows, rows without their raw frame, and sums, after a run in batches."""
    folder = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    sinks.written(flows.events(spark, f"{d}/events.parquet", 1), folder, TABLES)
    got = {t.name: sinks.table(spark, folder, t) for t in TABLES}
    raw = got["raw"].select("ordinal", F.lit(True).alias("there"))
    size = lambda t: F.col("size") if "size" in t.columns else F.lit(None).cast("decimal(24,6)")
    each = [t.select(F.lit(name).alias("table_name"), "ordinal", size(t).alias("size")) for name, t in got.items()]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    return rows.join(raw, "ordinal", "left").groupBy("table_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("orphans"), F.sum("ordinal").alias("ordinals"), F.sum("size").cast("decimal(24,6)").alias("size"))


ORACLES: dict[str, str] = {
    # state: s, is the episode open, opened, asked, waiting markets, snapshots, withheld; a timeout is a step of its own before the frame
    "stream_recoveries": f"""WITH RECURSIVE f AS (SELECT user_id // {STREAMS} AS stream, event_id AS ordinal, epoch_us(ts) // 1000 AS ms, {_KIND} AS kind, user_id AS market,
        list_filter([user_id, user_id + 1, user_id - 1], lambda m: m // {STREAMS} = user_id // {STREAMS} AND m >= 0) AS affected, row_number() OVER (PARTITION BY user_id // {STREAMS} ORDER BY event_id) AS i FROM events),
      last AS (SELECT max(epoch_us(ts) // 1000) - {HOUR} AS mark FROM events), ends AS (SELECT stream, max(i) + 1 AS i, (SELECT mark FROM last) AS ms FROM f GROUP BY stream),
      steps AS (SELECT stream, i, ms, kind, market, affected FROM f UNION ALL SELECT stream, i, ms, 'clock', NULL, [] FROM ends),
      walk AS (SELECT stream, CAST(0 AS BIGINT) AS i, 'healthy' AS state, CAST(0 AS BIGINT) AS episode, false AS up, CAST(NULL AS BIGINT) AS opened, CAST(NULL AS BIGINT) AS asked, CAST([] AS BIGINT[]) AS waiting, 0 AS snapshots, 0 AS withheld,
          CAST(NULL AS VARCHAR) AS event, CAST(NULL AS BIGINT) AS ms, CAST([] AS BIGINT[]) AS said_left, CAST(NULL AS BIGINT) AS due, false AS timed, 0 AS timed_left, 0 AS timed_snapshots, 0 AS timed_withheld, CAST(NULL AS BIGINT) AS timed_opened, CAST(0 AS BIGINT) AS timed_episode
        FROM (SELECT DISTINCT stream FROM f) x
        UNION ALL SELECT stream, i,
          CASE ev WHEN 'opened' THEN 'degraded' WHEN 'requested' THEN 'recovering' WHEN 'completed' THEN 'healthy' WHEN 'unavailable' THEN 'degraded' ELSE CASE WHEN kind = 'end' THEN 'healthy' WHEN out THEN 'degraded' ELSE state END END,
          CASE WHEN ev = 'opened' THEN episode + 1 ELSE episode END, CASE WHEN ev = 'opened' THEN true WHEN ev IN ('completed', 'unavailable', 'superseded') THEN false ELSE is_up END,
          CASE WHEN ev = 'opened' THEN at_ms ELSE opened END, CASE ev WHEN 'opened' THEN NULL WHEN 'requested' THEN at_ms ELSE asked END,
          CASE WHEN ev = 'opened' THEN affected WHEN ev IN ('completed', 'unavailable', 'superseded') THEN [] WHEN ev = 'snapshot' THEN rest WHEN out THEN [] ELSE waiting END,
          CASE WHEN ev = 'opened' THEN 0 WHEN ev IN ('snapshot', 'completed') THEN snapshots + 1 ELSE snapshots END,
          CASE WHEN ev = 'opened' THEN 0 WHEN is_up AND kind IN ('gap', 'frame') THEN withheld + 1 ELSE withheld END, ev, at_ms,
          CASE WHEN ev = 'opened' THEN affected WHEN ev IN ('snapshot', 'completed') THEN rest ELSE waiting END, was_due, out, CAST(len(waiting) AS INT), snapshots, withheld, opened, episode
        FROM (SELECT *, CASE WHEN kind = 'gap' THEN CASE WHEN NOT is_up THEN 'opened' END WHEN NOT is_up THEN NULL WHEN kind = 'end' THEN 'superseded' WHEN kind = 'request' THEN CASE WHEN state = 'degraded' THEN 'requested' END
            WHEN kind = 'unavailable' THEN 'unavailable' WHEN kind = 'snapshot' THEN CASE WHEN list_contains(waiting, market) THEN CASE WHEN len(rest) = 0 THEN 'completed' ELSE 'snapshot' END END END AS ev
          FROM (SELECT w.*, w.up AND NOT w.late AS is_up, w.up AND w.late AS out, list_filter(w.waiting, lambda m: m <> w.market) AS rest
            FROM (SELECT v.stream, s.i, v.state, v.episode, v.up, v.opened, v.asked, v.waiting, v.snapshots, v.withheld, s.kind, s.market, s.affected, s.ms AS at_ms, coalesce(v.asked, v.opened) + {TIMEOUT} AS was_due, s.ms >= coalesce(v.asked, v.opened) + {TIMEOUT} AS late
              FROM walk v JOIN steps s ON s.stream = v.stream AND s.i = v.i + 1) w) x) y)
      SELECT stream, episode, ms, event, CASE WHEN event = 'superseded' THEN 'closed' ELSE state END AS state, opened AS opened_ms, CAST(len(said_left) AS INT) AS outstanding, snapshots, withheld FROM walk WHERE event IS NOT NULL
      UNION ALL SELECT stream, timed_episode, due, 'timeout', 'degraded', timed_opened, timed_left, timed_snapshots, timed_withheld FROM walk WHERE timed""",
    "stream_samples": f"""WITH rows AS (SELECT n.*, CASE WHEN event_type = 'error' THEN true ELSE ok END AS good FROM numbered n WHERE event_type <> 'purchase'),
      span AS (SELECT market, ceil(min(ms) / {STEP}.0) * {STEP} AS first, greatest((max(ms) - 1) // {STEP}, ((SELECT max(ms) FROM ev) - {HOUR} - 1) // {STEP}) * {STEP} AS last FROM rows GROUP BY market),
      grid AS (SELECT market, unnest(generate_series(CAST(first AS BIGINT), last, {STEP})) AS bucket_ms FROM span),
      now AS (SELECT g.market, g.bucket_ms, arg_max(r.epoch, r.event_id) AS epoch, arg_max(r.n, r.event_id) AS n, coalesce(arg_max(r.good AND r.epoch > 0, r.event_id), false) AS valid
        FROM grid g JOIN rows r ON r.market = g.market AND r.ms <= g.bucket_ms GROUP BY g.market, g.bucket_ms),
      books AS (SELECT w.market, w.bucket_ms, any_value(w.valid) AS valid, any_value(w.epoch) AS epoch, CAST(count(h.size) AS INT) AS levels, coalesce(string_agg(h.side || h.price || '@' || h.size, ',' ORDER BY h.side, h.price), '') AS book,
          max(CASE WHEN side = 'yes' THEN price END) AS bid, max_by(CASE WHEN side = 'yes' THEN size END, CASE WHEN side = 'yes' THEN price END) AS bid_size,
          max(CASE WHEN side = 'no' THEN price END) AS no, max_by(CASE WHEN side = 'no' THEN size END, CASE WHEN side = 'no' THEN price END) AS ask_size
        FROM now w LEFT JOIN held h ON h.market = w.market AND h.epoch = w.epoch AND w.epoch > 0 AND h.from_n <= w.n AND (h.to_n IS NULL OR w.n < h.to_n) AND h.size > 0 GROUP BY w.market, w.bucket_ms),
      known AS (SELECT *, last_value(CASE WHEN valid THEN book END IGNORE NULLS) OVER (PARTITION BY market ORDER BY bucket_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM books)
      SELECT market, bucket_ms, valid, CASE WHEN valid THEN bid END AS bid, CASE WHEN valid THEN bid_size END AS bid_size, CASE WHEN valid THEN CAST(1 - no AS DECIMAL(12,6)) END AS ask, CASE WHEN valid THEN ask_size END AS ask_size,
        levels, valid AND book IS DISTINCT FROM before AS written FROM known""",
    "stream_tables": """WITH first_deltas AS (SELECT min(event_id) AS ordinal, arg_min(CAST(round(value, 2) AS DECIMAL(24,6)), event_id) AS size FROM events WHERE event_type IN ('view', 'click', 'signup') GROUP BY user_id, event_id - CAST(event_id % 50 = 0 AS INT)),
      first_trades AS (SELECT min(event_id) AS ordinal, arg_min(CAST(round(value, 2) AS DECIMAL(24,6)), event_id) AS size FROM events WHERE event_type = 'purchase' GROUP BY event_id // 3)
      SELECT 'raw' AS table_name, count(*) AS n, CAST(0 AS BIGINT) AS orphans, CAST(sum(event_id) AS BIGINT) AS ordinals, CAST(NULL AS DECIMAL(24,6)) AS size FROM events
      UNION ALL SELECT 'gaps', count(*), 0, CAST(sum(event_id) AS BIGINT), NULL FROM events WHERE event_type = 'error'
      UNION ALL SELECT 'deltas', count(*), 0, CAST(sum(ordinal) AS BIGINT), CAST(sum(size) AS DECIMAL(24,6)) FROM first_deltas
      UNION ALL SELECT 'trades', count(*), 0, CAST(sum(ordinal) AS BIGINT), CAST(sum(size) AS DECIMAL(24,6)) FROM first_trades""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (stream_recoveries, stream_samples, stream_tables)}
