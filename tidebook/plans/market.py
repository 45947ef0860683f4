"""Queries built from the operators: as-of lookups, books on a grid, markouts, folds, simulation and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import book, evidence, execution, folds, temporal
from tidebook.sources import lake
from tidebook.streaming import flows
from tidebook.tables import load, view

DAY, HOUR = 86_400_000, 3_600_000


def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    right = view(spark, d, "trades").selectExpr("market", "us", "price AS last_price", "event_id AS trade_id")
    return temporal.asof_join(view(spark, d, "resets").select("event_id", "market", "us"), right, ["market"], "us", ["last_price", "trade_id"])


def asof_lagged(spark: SparkSession, d: str) -> DataFrame:
    left = view(spark, d, "resets").select("event_id", "market", F.explode(F.array(F.lit(0), F.lit(DAY * 1000))).alias("lag"), "us")
    left = left.withColumn("us", F.col("us") - F.col("lag"))
    return temporal.asof_join(left, view(spark, d, "trades").selectExpr("market", "us", "event_id AS trade_id"), ["market"], "us", ["trade_id"])


def _grid(spark: SparkSession, d: str) -> DataFrame:
    last = view(spark, d, "ev").agg(F.max("ms")).first()[0] or 0
    return book.on_grid(book.level_intervals(view(spark, d, "applied"), view(spark, d, "resets")), DAY, last)


def final_tops(spark: SparkSession, d: str) -> DataFrame:
    """Per market the best prices and sizes of its last book, and whether that book is valid."""
    applied = view(spark, d, "applied")
    last = book.level_intervals(applied, view(spark, d, "resets")).where("to_ms IS NULL")
    top = lambda side: F.max(F.when(F.col("side") == side, F.struct("price", "size")))
    tops = last.groupBy("market").agg(top("yes").alias("y"), top("no").alias("n"))
    epochs = applied.groupBy("market").agg(F.max_by(F.col("cut").isNull(), "epoch").alias("valid"))
    return epochs.join(tops, "market", "left").select("market", "valid", F.col("y.price").alias("bid"), (1 - F.col("n.price")).cast("decimal(12,6)").alias("ask"), F.col("y.size").alias("bid_size"), F.col("n.size").alias("ask_size"))


def grid_clock(spark: SparkSession, d: str) -> DataFrame:
    return book.best_prices(_grid(spark, d))


def book_hash(spark: SparkSession, d: str) -> DataFrame:
    return book.state_hash(_grid(spark, d), ["market", "bucket_ms"])


def taker_sweep(spark: SparkSession, d: str) -> DataFrame:
    levels = view(spark, d, "deltas").where("side = 'no' AND delta > 0").groupBy("market", F.expr("CAST(1 - price AS DECIMAL(12,6))").alias("price")).agg(F.sum("delta").cast("decimal(24,6)").alias("size"))
    return folds.taker_sweep(levels.selectExpr("*", "CAST(500 AS DECIMAL(24,6)) AS qty", "CAST(0.8 AS DECIMAL(12,6)) AS lim"), ["market"], "qty", "lim")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """A queue reading per trade after a market's first: the reported move is the fall of the trade's size."""
    return view(spark, d, "trades").selectExpr("market", "event_id AS id", "taker_side AS side", "price", "ms AS t1", "lag(ms) OVER (PARTITION BY market ORDER BY event_id) AS t0",
        "CAST(lag(size) OVER (PARTITION BY market ORDER BY event_id) - size AS DECIMAL(24,6)) AS moved").where("t0 IS NOT NULL")


def lag_search_depth(spark: SparkSession, d: str) -> DataFrame:
    """The lag, of 31, at which the book's move in depth ahead is nearest to the reported one; a unit of lag is 1000 s."""
    intervals = book.level_intervals(view(spark, d, "applied"), view(spark, d, "resets"))
    return evidence.lag_search(_readings(spark, d), intervals, 1_000_000).withColumnRenamed("id", "event_id")


def lag_histogram_depth(spark: SparkSession, d: str) -> DataFrame:
    return lag_search_depth(spark, d).groupBy("best_lag").agg(F.count("*").alias("n"))


def _shipped() -> None:
    """Python operators travel with their plans, so executors need no installed package."""
    from pyspark import cloudpickle
    import tidebook

    cloudpickle.register_pickle_by_value(tidebook)


def _intents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An order at the price of every delta, and all prints."""
    orders = view(spark, d, "deltas").selectExpr("market", "event_id AS order_id", "ms", "CASE side WHEN 'yes' THEN 'bid' ELSE 'ask' END AS side", "CAST(price AS DOUBLE) AS price", "5D AS qty", "20D AS ahead", f"ms + {DAY * 30}L AS cancel_at")
    trades = view(spark, d, "trades").selectExpr("market", "event_id AS trade_id", "ms", "CASE taker_side WHEN 'yes' THEN 'ask' ELSE 'bid' END AS hits", "CAST(price AS DOUBLE) AS price", "CAST(size AS DOUBLE) AS size")
    return orders, trades


def backtest_join_bid(spark: SparkSession, d: str) -> DataFrame:
    """Orders resting at a price, simulated under two fill models with the same intents."""
    _shipped()
    return execution.simulate(*_intents(spark, d)).drop("latency_ms")


def experiment_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Fills, contracts and filled orders of every fill model under three latencies."""
    _shipped()
    fills = execution.simulate(*_intents(spark, d), latencies=(0, HOUR, DAY))
    return fills.groupBy("model", "latency_ms").agg(
        F.count("*").alias("fills"), F.countDistinct("order_id").alias("orders"), F.sum(F.col("qty").cast("decimal(24,6)")).cast("decimal(28,6)").alias("qty")
    )


def order_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Views submit an order, clicks replace the market's last one and signups cancel it; errors are gaps."""
    _shipped()
    last = "last(CASE WHEN kind <> 'cancel' THEN order_id END, true) OVER (PARTITION BY market ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target"
    actions = view(spark, d, "deltas").join(view(spark, d, "ev").select("event_id", "event_type"), "event_id").selectExpr(
        "market", "event_id AS seq", "ms", "CASE event_type WHEN 'view' THEN 'submit' WHEN 'click' THEN 'replace' ELSE 'cancel' END AS kind", "event_id AS order_id",
        "CASE side WHEN 'yes' THEN 'bid' ELSE 'ask' END AS side", "CAST(price AS DOUBLE) AS price", "CAST(abs(delta) AS DOUBLE) AS qty",
    ).selectExpr("*", last)
    prints = view(spark, d, "trades").selectExpr("market", "event_id AS seq", "ms", "'trade' AS kind", "CASE taker_side WHEN 'yes' THEN 'ask' ELSE 'bid' END AS side", "CAST(price AS DOUBLE) AS price", "CAST(size AS DOUBLE) AS size")
    gaps = view(spark, d, "resets").selectExpr("market", "event_id AS seq", "ms", "'gap' AS kind", "CAST(NULL AS STRING) AS side", "CAST(NULL AS DOUBLE) AS price", "CAST(NULL AS DOUBLE) AS size")
    return execution.lifecycle(actions, prints.unionByName(gaps))


def depth_imbalance(spark: SparkSession, d: str) -> DataFrame:
    return book.features(_grid(spark, d))


def ladder_hash(spark: SparkSession, d: str) -> DataFrame:
    """One hash over all books of a series at an instant."""
    return book.ladder_hash(book_hash(spark, d).withColumn("series", F.col("market") % 8), ["series", "bucket_ms"], "market")


def contract_types(spark: SparkSession, d: str) -> DataFrame:
    """Breaches of the deltas' contract in the derived table, one row each."""
    deltas = view(spark, d, "deltas").selectExpr("CAST(ordinal AS STRING) AS ingest_ordinal", "price", "delta AS delta_count", "CAST(price AS DOUBLE) AS pre_count")
    return spark.createDataFrame([(b,) for b in lake.contract(deltas, lake.schema("deltas"))], "breach string")


def dataset_files(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each file that a scan reads."""
    return load(spark, d, "events").groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).agg(F.count("*").alias("n"))


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = flows.drained(flows.tumbling(flows.events(spark, f"{d}/events.parquet")), "complete")
    return out.select("user_id", F.unix_millis("window.start").alias("start_ms"), "n", F.col("volume").cast("decimal(24,6)").alias("volume"))


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = flows.drained(flows.sliding(flows.events(spark, f"{d}/events.parquet")), "complete")
    return out.select(F.unix_millis("window.start").alias("start_ms"), "n")


def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return flows.drained(flows.deduplicated(flows.events(spark, f"{d}/events.parquet"), ["event_id"]), "append").select("event_id")


_FRAMES = "CASE WHEN event_id % 97 = 33 THEN NULL ELSE event_id + CASE event_id % 97 WHEN 0 THEN 3 WHEN 50 THEN -1 WHEN 70 THEN -4 ELSE 0 END END AS seq"


def stream_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of streams of 500 frames; errors are recoveries."""
    _shipped()
    frames = flows.events(spark, f"{d}/events.parquet").selectExpr("event_id div 500 AS stream", "event_id AS ordinal", "event_type = 'error' AS recovery", _FRAMES)
    return flows.drained(flows.verdicts(frames), "append").groupBy("verdict").agg(F.count("*").alias("n"))


def stream_books(spark: SparkSession, d: str) -> DataFrame:
    """Best prices after every delta and reset, from the stream's state."""
    _shipped()
    frames = flows.events(spark, f"{d}/events.parquet").where("event_type <> 'purchase'").selectExpr(
        "user_id AS market", "event_id AS ordinal", "unix_millis(at) AS ms", "CASE event_type WHEN 'error' THEN 'reset' ELSE 'delta' END AS kind", "CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS side",
        "(event_id * 7 % 45 + 3) * 10000 AS price", "CAST(CASE WHEN event_type = 'signup' THEN -least(round(value, 2), 4) ELSE round(value, 2) END * 100 + 0.5 * sign(CASE WHEN event_type = 'signup' THEN -1 ELSE 1 END) AS BIGINT) * 10000 AS delta")
    out = flows.drained(flows.books(frames), "append")
    dec = lambda c, kind: (F.col(c).cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast(kind).alias(c)
    return out.select(F.col("ordinal").alias("event_id"), "market", dec("bid", "decimal(12,6)"), dec("bid_size", "decimal(24,6)"), dec("ask", "decimal(12,6)"), dec("ask_size", "decimal(24,6)"))


_GRID = f"""spans AS (SELECT a.market, a.side, a.price, a.post AS size, a.ms AS from_ms, coalesce(lead(a.ms) OVER (PARTITION BY a.market, a.epoch, a.side, a.price ORDER BY a.event_id),
    (SELECT min(c.ms) FROM applied c WHERE c.cut = c.event_id AND c.market = a.market AND c.epoch = a.epoch),
    (SELECT min(r.ms) FROM resets r WHERE r.market = a.market AND r.event_id > a.event_id), (SELECT max(ms) + 1 FROM ev)) AS to_ms FROM applied a WHERE a.ok),
  cells AS (SELECT market, side, price, size, b.bucket_ms FROM spans JOIN (SELECT unnest(generate_series((SELECT min(ms) // {DAY} FROM ev), (SELECT max(ms) // {DAY} + 1 FROM ev))) * {DAY} AS bucket_ms) b
    ON b.bucket_ms >= from_ms AND b.bucket_ms < to_ms WHERE size > 0)"""

ORACLES: dict[str, str] = {
    "asof_backward": "SELECT r.event_id, r.market, r.us, t.price AS last_price, t.event_id AS trade_id FROM resets r ASOF LEFT JOIN trades t ON t.market = r.market AND r.us >= t.us",
    "asof_lagged": f"SELECT l.event_id, l.market, l.lag, l.us, t.event_id AS trade_id FROM (SELECT event_id, market, CAST(lag AS BIGINT) AS lag, us - lag AS us FROM resets, (VALUES (0), ({DAY * 1000})) v(lag)) l ASOF LEFT JOIN trades t ON t.market = l.market AND l.us >= t.us",
    "grid_clock": f"""WITH {_GRID}, tops AS (SELECT *, row_number() OVER (PARTITION BY market, bucket_ms, side ORDER BY price DESC) AS r FROM cells)
        SELECT market, bucket_ms, max(CASE WHEN side = 'yes' THEN price END) AS bid, CAST(1 - max(CASE WHEN side = 'no' THEN price END) AS DECIMAL(12,6)) AS ask,
        CAST(1 - max(CASE WHEN side = 'no' THEN price END) - max(CASE WHEN side = 'yes' THEN price END) AS DECIMAL(12,6)) AS spread,
        CAST(sum(CASE WHEN side = 'yes' THEN size END) AS DECIMAL(24,6)) AS bid_depth, CAST(sum(CASE WHEN side = 'no' THEN size END) AS DECIMAL(24,6)) AS ask_depth FROM tops WHERE r <= 3 GROUP BY market, bucket_ms""",
    "book_hash": f"""WITH {_GRID} SELECT market, bucket_ms, sha256(CAST(market AS VARCHAR) || chr(10) || 'yes:' || coalesce(string_agg(CASE WHEN side = 'yes' THEN price || '@' || size END, ',' ORDER BY price DESC), '')
        || chr(10) || 'no:' || coalesce(string_agg(CASE WHEN side = 'no' THEN price || '@' || size END, ',' ORDER BY price DESC), '')) AS hash FROM cells GROUP BY market, bucket_ms""",
    "taker_sweep": """WITH l AS (SELECT market, CAST(1 - price AS DECIMAL(12,6)) AS price, CAST(sum(delta) AS DECIMAL(24,6)) AS size FROM deltas WHERE side = 'no' AND delta > 0 GROUP BY market, price),
        c AS (SELECT market, price, CASE WHEN price <= 0.8 THEN greatest(0, least(size, 500 - coalesce(sum(size) OVER (PARTITION BY market ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS took FROM l)
        SELECT market, CAST(sum(took) AS DECIMAL(24,6)) AS filled, CAST(sum(CAST(took AS DECIMAL(24,6)) * price) AS DECIMAL(38,12)) AS cost FROM c GROUP BY market""",
    "stream_tumbling": f"SELECT market AS user_id, CAST(floor(us / {DAY * 1000}) AS BIGINT) * {DAY} AS start_ms, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(24,6))) AS DECIMAL(24,6)) AS volume FROM (SELECT *, (SELECT 1) AS one FROM ev) e JOIN (SELECT event_id, value FROM events) v USING (event_id) GROUP BY market, CAST(floor(us / {DAY * 1000}) AS BIGINT)",
    "stream_sliding": f"SELECT d * {DAY} AS start_ms, count(*) AS n FROM (SELECT unnest([day, day - 1]) AS d FROM (SELECT CAST(floor(us / {DAY * 1000}) AS BIGINT) AS day FROM ev) x) y GROUP BY d",
    "stream_dedupe": "SELECT event_id FROM events",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        asof_backward, asof_lagged, grid_clock, book_hash, taker_sweep, lag_search_depth, lag_histogram_depth,
        backtest_join_bid, experiment_matrix, order_lifecycle, depth_imbalance, ladder_hash, contract_types, dataset_files, stream_tumbling, stream_sliding, stream_dedupe, stream_verdicts, stream_books,
    )
    return {f.__name__: f for f in own}




_DEPTHS = (1, 3, 5, 10)
_SIZE = "CAST(sum(CASE WHEN side = '{s}' AND r <= {k} THEN size END) AS DOUBLE)"
ORACLES["depth_imbalance"] = f"""WITH {_GRID}, tops AS (SELECT *, row_number() OVER (PARTITION BY market, bucket_ms, side ORDER BY price DESC) AS r FROM cells),
    b AS (SELECT market, bucket_ms, CAST(max(CASE WHEN side = 'yes' THEN price END) AS DOUBLE) AS bid, CAST(CAST(1 - max(CASE WHEN side = 'no' THEN price END) AS DECIMAL(12,6)) AS DOUBLE) AS ask,
      {", ".join(f"{_SIZE.format(s='yes', k=k)} AS y{k}, {_SIZE.format(s='no', k=k)} AS n{k}" for k in _DEPTHS)} FROM tops GROUP BY market, bucket_ms)
    SELECT market, bucket_ms, round((bid + ask) / 2, 6) AS mid, round((bid * n1 + ask * y1) / (y1 + n1), 6) AS microprice, {", ".join(f"round((y{k} - n{k}) / (y{k} + n{k}), 6) AS imbalance_{k}" for k in _DEPTHS)} FROM b"""
ORACLES["ladder_hash"] = f"""SELECT market % 8 AS series, bucket_ms, sha256(string_agg(CAST(market AS VARCHAR) || '=' || hash, chr(10) ORDER BY CAST(market AS VARCHAR))) AS hash, count(*) AS members
    FROM ({ORACLES["book_hash"]}) h GROUP BY market % 8, bucket_ms"""
_AHEAD = """(SELECT CASE WHEN count(*) > 0 THEN CAST(coalesce(sum(s.size) FILTER (s.to_ms IS NULL OR s.to_ms > {t}), 0) AS DECIMAL(24,6)) END FROM level_spans s
    WHERE s.market = r.market AND s.side = r.side AND s.price >= r.price AND s.from_ms <= {t})"""
ORACLES["lag_search_depth"] = f"""WITH r AS (SELECT * FROM (SELECT market, event_id, taker_side AS side, price, ms AS t1, lag(ms) OVER w AS t0, CAST(lag(size) OVER w - size AS DECIMAL(24,6)) AS moved FROM trades WINDOW w AS (PARTITION BY market ORDER BY event_id)) x WHERE t0 IS NOT NULL),
    tried AS (SELECT r.event_id, lag, CAST(abs(moved - ({_AHEAD.format(t="r.t0 - lag * 1000000")} - {_AHEAD.format(t="r.t1 - lag * 1000000")})) AS DECIMAL(24,6)) AS residual FROM r, (SELECT unnest(generate_series({evidence.LAGS[0]}, {evidence.LAGS[-1]}, 100)) AS lag) l)
    SELECT event_id, CAST(arg_min(lag, row(residual, lag)) FILTER (residual IS NOT NULL) AS BIGINT) AS best_lag, min(residual) AS residual FROM tried GROUP BY event_id"""
ORACLES["lag_histogram_depth"] = f"SELECT best_lag, count(*) AS n FROM ({ORACLES['lag_search_depth']}) x GROUP BY best_lag"
ORACLES["dataset_files"] = "SELECT 'events.parquet' AS file, count(*) AS n FROM events"
ORACLES["stream_verdicts"] = f"""WITH RECURSIVE fr AS (SELECT event_id // 500 AS stream, event_id % 500 AS rn, event_type = 'error' AS recovery, {_FRAMES} FROM events),
    walk AS (SELECT stream, CAST(-1 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS top, false AS bad, CAST(NULL AS VARCHAR) AS verdict FROM (SELECT DISTINCT stream FROM fr) s UNION ALL
      SELECT f.stream, f.rn, CASE WHEN recovery THEN seq WHEN bad OR seq IS NULL THEN top WHEN top IS NULL OR seq = top + 1 THEN seq ELSE top END, NOT recovery AND (bad OR coalesce(seq > top + 1, false)),
        CASE WHEN recovery THEN 'recovered' WHEN seq IS NULL THEN 'unsequenced' WHEN bad THEN 'degraded' WHEN top IS NULL THEN 'first' WHEN seq = top + 1 THEN 'ok' WHEN seq = top THEN 'duplicate' WHEN seq < top THEN 'out_of_order' ELSE 'gap' END
      FROM walk w JOIN fr f ON f.stream = w.stream AND f.rn = w.rn + 1) SELECT verdict, count(*) AS n FROM walk WHERE rn >= 0 GROUP BY verdict"""
