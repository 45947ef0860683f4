"""Queries of wire frames: typed events, quarantine, and what may change a book; their oracles read the text as JSON elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import folds
from tidebook.sources import frames
from tidebook.tables import view

#: Numbers of a stream as received: some missing, repeated, late or ahead.
_SEQ = "CASE WHEN ordinal % 97 = 33 THEN NULL ELSE ordinal + CASE ordinal % 97 WHEN 0 THEN 3 WHEN 50 THEN -1 WHEN 70 THEN -4 ELSE 0 END END"


def frame_events(spark: SparkSession, d: str) -> DataFrame:
    """Every frame once: as a typed event, as raw, or in quarantine with its reason."""
    rows = frames.parsed(view(spark, d, "frames"))
    best = lambda c: F.array_max(F.transform(c, lambda x: x["price"]))
    total = lambda c: F.aggregate(c, F.lit(0).cast("decimal(24,6)"), lambda a, x: (a + x["size"]).cast("decimal(24,6)"))
    return rows.select(
        "ordinal", "kind", "reason", "type", "sid", "seq", "market", "exchange_ms", "side", "price", "delta", "trade_id", "yes_price", "no_price", "count", "taker_side", "is_block",
        F.size("yes_levels").alias("n_yes"), best("yes_levels").alias("best_yes"), total("yes_levels").alias("yes_size"), F.size("no_levels").alias("n_no"), best("no_levels").alias("best_no"),
    ).withColumns({c: F.when(F.col("kind") == "snapshot", F.col(c)) for c in ("n_yes", "n_no")})


def frame_gates(spark: SparkSession, d: str) -> DataFrame:
    """What frames may change a book, by kind: sequence numbers first, then recovery, then whether they could be read."""
    rows = frames.parsed(view(spark, d, "frames")).withColumn("stream", F.floor(F.col("ordinal") / 500)).withColumn("recovery", F.coalesce(F.col("kind") == "snapshot", F.lit(False))).withColumn("seq", F.expr(_SEQ))
    said = frames.gated(folds.sequence_verdicts(rows))
    return said.groupBy("kind", "skip_reason", "applies").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_at"))


_SIX = lambda x, kind="DECIMAL(12,6)": f"CAST(round_even(TRY_CAST(CASE WHEN regexp_matches({x}, '^-?[0-9]+(\\.[0-9]+)?$') THEN {x} END AS DECIMAL(30,12)), 6) AS {kind})"
_AT = lambda p: f"json_extract_string(j, '$.msg.{p}')"
_LADDER = lambda s: f"list_transform(CAST(json_extract(j, '$.msg.{s}_dollars_fp') AS VARCHAR[][]), lambda x: struct_pack(price := {_SIX('x[1]')}, size := {_SIX('x[2]', 'DECIMAL(24,6)')}))"
_PARSED = f"""f AS (SELECT *, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j FROM frames),
    g AS (SELECT *, json_extract_string(j, '$.type') AS type, CASE json_extract_string(j, '$.type') WHEN 'orderbook_snapshot' THEN 'snapshot' WHEN 'orderbook_delta' THEN 'delta' WHEN 'trade' THEN 'trade' END AS k, CAST(json_extract(j, '$.sid') AS BIGINT) AS sid, CAST(json_extract(j, '$.seq') AS BIGINT) AS seq,
      {_AT("market_ticker")} AS market, CAST(json_extract(j, '$.msg.ts_ms') AS BIGINT) AS exchange_ms, {_AT("side")} AS side, {_SIX(_AT("price_dollars"))} AS price, {_SIX(_AT("delta_fp"), "DECIMAL(24,6)")} AS delta, {_AT("trade_id")} AS trade_id,
      {_SIX(_AT("yes_price_dollars"))} AS yes_price, {_SIX(_AT("no_price_dollars"))} AS no_price, {_SIX(_AT("count_fp"), "DECIMAL(24,6)")} AS count, coalesce({_AT("taker_outcome_side")}, {_AT("taker_side")}) AS taker_side, coalesce(CAST(json_extract(j, '$.msg.is_block_trade') AS BOOLEAN), false) AS is_block,
      coalesce({_LADDER("yes")}, []) AS ys, coalesce({_LADDER("no")}, []) AS ns FROM f),
    h AS (SELECT *, CASE WHEN j IS NULL THEN 'not json' WHEN type IS NULL THEN 'no type' WHEN k IS NOT NULL AND market IS NULL THEN 'schema: market_ticker'
      WHEN k = 'snapshot' AND len(list_filter(ys, lambda x: x.price IS NULL OR x.size IS NULL)) > 0 THEN 'schema: yes_dollars_fp' WHEN k = 'snapshot' AND len(list_filter(ns, lambda x: x.price IS NULL OR x.size IS NULL)) > 0 THEN 'schema: no_dollars_fp'
      WHEN k = 'delta' AND price IS NULL THEN 'schema: price_dollars' WHEN k = 'delta' AND delta IS NULL THEN 'schema: delta_fp' WHEN k = 'delta' AND coalesce(side NOT IN ('yes', 'no'), true) THEN 'schema: side'
      WHEN k = 'trade' AND trade_id IS NULL THEN 'schema: trade_id' WHEN k = 'trade' AND yes_price IS NULL THEN 'schema: yes_price_dollars' WHEN k = 'trade' AND no_price IS NULL THEN 'schema: no_price_dollars' WHEN k = 'trade' AND count IS NULL THEN 'schema: count_fp'
      WHEN k = 'trade' AND taker_side NOT IN ('yes', 'no') THEN 'schema: taker_outcome_side' END AS reason FROM g),
    parsed AS (SELECT *, CASE WHEN reason IS NULL THEN coalesce(k, 'raw') END AS kind FROM h)"""
_OWN = lambda kind, *names: ", ".join(f"CASE WHEN kind = '{kind}' THEN {n} END AS {n}" for n in names)

ORACLES: dict[str, str] = {
    "frame_events": f"""WITH {_PARSED} SELECT ordinal, kind, reason, type, sid, seq, market, exchange_ms, {_OWN("delta", "side", "price", "delta")}, {_OWN("trade", "trade_id", "yes_price", "no_price", "count", "taker_side", "is_block")},
        CASE WHEN kind = 'snapshot' THEN CAST(len(ys) AS INT) END AS n_yes, CASE WHEN kind = 'snapshot' THEN list_max(list_transform(ys, lambda x: x.price)) END AS best_yes, CASE WHEN kind = 'snapshot' THEN CAST(coalesce(list_sum(list_transform(ys, lambda x: x.size)), 0) AS DECIMAL(24,6)) END AS yes_size,
        CASE WHEN kind = 'snapshot' THEN CAST(len(ns) AS INT) END AS n_no, CASE WHEN kind = 'snapshot' THEN list_max(list_transform(ns, lambda x: x.price)) END AS best_no FROM parsed""",
    "frame_gates": f"""WITH RECURSIVE {_PARSED}, fr AS (SELECT ordinal, ordinal // 500 AS stream, ordinal % 500 AS rn, kind, reason, coalesce(kind = 'snapshot', false) AS recovery, {_SEQ} AS seq FROM parsed),
      walk AS (SELECT stream, CAST(-1 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS top, false AS bad, CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS BIGINT) AS ordinal, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT stream FROM fr) s UNION ALL
        SELECT f.stream, f.rn, CASE WHEN recovery THEN seq WHEN bad OR seq IS NULL THEN top WHEN top IS NULL OR seq = top + 1 THEN seq ELSE top END, NOT recovery AND (bad OR coalesce(seq > top + 1, false)),
          CASE WHEN recovery THEN 'recovered' WHEN seq IS NULL THEN 'unsequenced' WHEN bad THEN 'degraded' WHEN top IS NULL THEN 'first' WHEN seq = top + 1 THEN 'ok' WHEN seq = top THEN 'duplicate' WHEN seq < top THEN 'out_of_order' ELSE 'gap' END, f.ordinal, f.kind, f.reason
        FROM walk w JOIN fr f ON f.stream = w.stream AND f.rn = w.rn + 1),
      said AS (SELECT *, CASE WHEN verdict IN ('gap', 'duplicate', 'out_of_order') THEN 'sequence ' || verdict WHEN verdict = 'degraded' AND coalesce(kind <> 'snapshot', true) THEN 'stream degraded; awaiting recovery snapshot' WHEN reason IS NOT NULL THEN 'quarantined' END AS skip_reason FROM walk WHERE rn >= 0)
      SELECT kind, skip_reason, skip_reason IS NULL AND kind IN ('snapshot', 'delta', 'trade') AS applies, count(*) AS n, min(ordinal) AS first_at FROM said GROUP BY ALL""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (frame_events, frame_gates)}
