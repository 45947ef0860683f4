"""Queries of replayed books, sequence verdicts, level evidence and fills, with oracles in other terms.

Spark folds, windows and as-of joins stand against DuckDB recursions and inequality joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import scalar as S
from tidebook.operators import book, folds, replay
from tidebook.operators.temporal import asof_join
from tidebook.storage import stage_table
from tidebook.tables import view

#: The given tables' events lie hours apart: a millisecond of a horizon, window or cooldown counts as so many.
UNIT = 10_000
#: Markout horizons in milliseconds.
HORIZONS = (50, 100, 250, 500, 1_000, 5_000, 30_000)
BUCKET_HORIZON = 5_000
WINDOW, COOLDOWN, DAY, CHECK = 120_000 * 1000, 60_000 * 1000, 86_400_000, 5


def _shipped() -> None:
    """Python operators travel with their plans, so executors need no installed package."""
    import tidebook
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(tidebook)


def _states(spark: SparkSession, d: str) -> DataFrame:
    return replay.states(view(spark, d, "applied"))


def _mids(spark: SparkSession, d: str) -> DataFrame:
    return replay.mid_series(_states(spark, d), view(spark, d, "resets"))


def _held_mids(spark: SparkSession, d: str) -> DataFrame:
    """Mids as a written table, for plans that look them up more than once: the books are replayed once."""
    return stage_table(_mids(spark, d), "mids")


def delta_apply(spark: SparkSession, d: str) -> DataFrame:
    """What each delta did, by running sums: no fold."""
    pre = (F.col("post") - F.col("delta")).cast(S.SIZE)
    action = F.when(~F.col("ok"), F.when(F.col("event_id") == F.col("cut"), "unknown")).when(F.col("post") == 0, "delete").when(pre == 0, "insert").when(F.col("delta") > 0, "increase").when(F.col("delta") == 0, "unknown").otherwise("decrease")
    reached = F.col("ok") | (F.col("event_id") == F.col("cut"))
    return view(spark, d, "applied").select("event_id", F.col("ok").alias("applied"), F.when(reached, pre).alias("pre"), F.when(reached, F.col("post")).alias("post"), action.alias("level_action"))


def event_time_rows(spark: SparkSession, d: str) -> DataFrame:
    """The book after every event, resets included."""
    rows = _states(spark, d).select("event_id", "market", "applied", "pre", "post", "level_action", "bid", "bid_size", "ask", "ask_size")
    return rows.unionByName(view(spark, d, "resets").select("event_id", "market", F.lit(True).alias("applied"), F.lit("seed").alias("level_action")), allowMissingColumns=True)


def replay_verify(spark: SparkSession, d: str) -> DataFrame:
    """Recorded state hashes against the replay's at the same position; a position that is not reached is a mismatch.

    The recorded ones come from level intervals; every 35th is spoilt, and some stand where the book was invalid.
    """
    # marks are numbered within their epoch, so that a size meets those that it stands at and no others
    turn, level = "(PARTITION BY market, epoch ORDER BY event_id ROWS UNBOUNDED PRECEDING)", "(PARTITION BY market, epoch, side, price ORDER BY event_id)"
    mark = f"event_id % {CHECK} = 0"
    counted = view(spark, d, "applied").selectExpr("market", "epoch", "event_id", "side", "price", "post", "ok", f"count_if({mark}) OVER {turn} AS k", f"{mark} AS is_mark")
    rows = stage_table(counted.selectExpr("*", "k - CAST(is_mark AS INT) AS past", "max(k) OVER (PARTITION BY market, epoch) AS marks"), "marks")
    marks = rows.where("is_mark").select("market", "epoch", F.col("event_id").alias("at"), "ok", "k")
    held = rows.selectExpr("*", f"coalesce(lead(past) OVER {level}, marks) AS upto").where("ok AND post > 0 AND past < upto").selectExpr("market", "epoch", "side", "price", "post AS size", "explode(sequence(past + 1, upto)) AS k")
    there = held.join(marks.select("market", "epoch", "at", "k"), ["market", "epoch", "k"])
    recorded = marks.join(book.state_hash(there, ["market", "at"]), ["market", "at"], "left").select("market", "at", F.when(F.col("at") % 35 == 0, "spoilt").otherwise(F.coalesce("hash", F.lit("empty"))).alias("expected"))
    empty = F.sha2(F.concat(F.col("market").cast("string"), F.lit("\nyes:\nno:")), 256)
    _shipped()
    replayed = replay.hashed(view(spark, d, "epochs"), CHECK).where("hash IS NOT NULL").select("market", F.col("event_id").alias("at"), F.when(F.col("hash") == empty, "empty").otherwise(F.col("hash")).alias("actual"))
    both = recorded.join(replayed, ["market", "at"], "left")
    return both.groupBy("market").agg(F.count("*").alias("checked"), F.count_if(F.col("expected") == F.col("actual")).alias("matched"), F.count_if(F.col("expected") != F.col("actual")).alias("mismatched"), F.count_if(F.col("actual").isNull()).alias("unreached"))


def grid_post_event(spark: SparkSession, d: str) -> DataFrame:
    """The look-ahead grid: every day from a market's first event to its last has the state after the next event."""
    rows = _states(spark, d).groupBy("market", "ms").agg(F.max_by(F.struct("event_id", "bid", "ask"), "event_id").alias("s")).selectExpr("market", "ms", "s.*")
    spans = rows.selectExpr("*", "lag(ms) OVER (PARTITION BY market ORDER BY ms) AS before")
    first = F.when(F.col("before").isNull(), F.ceil(F.col("ms") / DAY)).otherwise(F.floor(F.col("before") / DAY) + 1).cast("long")
    last = F.floor(F.col("ms") / DAY).cast("long")
    return spans.select("market", "event_id", "bid", "ask", F.explode(F.when(first <= last, F.sequence(first, last))).alias("day")).select("market", (F.col("day") * DAY).alias("bucket_ms"), F.col("event_id").alias("state_of"), "bid", "ask")


def mid_changes(spark: SparkSession, d: str) -> DataFrame:
    return _mids(spark, d).select("market", "ms", "mid", "micro")


def recent_activity(spark: SparkSession, d: str) -> DataFrame:
    """Trades, deltas and moves of the best prices in the trailing window of every trade."""
    tops = replay.mid_series(_states(spark, d), view(spark, d, "resets")).select("market", "ms", "bid", "ask")
    moves = tops.selectExpr("market", "ms", "struct(bid, ask) AS now", "lag(struct(bid, ask)) OVER (PARTITION BY market ORDER BY ms) AS was").where("was IS NULL OR NOT (now <=> was)")
    kinds = view(spark, d, "trades").select("market", "ms", "event_id", F.lit("t").alias("kind")).unionByName(view(spark, d, "deltas").select("market", "ms", F.lit("d").alias("kind")), True).unionByName(moves.select("market", "ms", F.lit("m").alias("kind")), True)
    n = lambda k, name: f"count_if(kind = '{k}') OVER (PARTITION BY market ORDER BY ms RANGE BETWEEN {WINDOW} PRECEDING AND CURRENT ROW) AS {name}"
    return kinds.selectExpr("event_id", n("t", "trades"), n("d", "deltas"), n("m", "moves")).where("event_id IS NOT NULL")


def ticker_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Trades' ticker prices against the book in force; of each market's mismatches one per cooldown is reported."""
    ticks = view(spark, d, "trades").selectExpr("market", "event_id", "ms", "price AS ticker_bid")
    seen = asof_join(ticks, _mids(spark, d).select("market", "ms", "bid"), ["market"], "ms", ["bid"])
    return replay.throttled(seen.where("bid IS NOT NULL AND bid <> ticker_bid"), "market", "ms", COOLDOWN)


def sequence_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return folds.sequence_verdicts(_frames(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_at"), F.max("ordinal").alias("last_at"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a stream per series; errors stand for recoveries, which set the baseline."""
    return view(spark, d, "ev").selectExpr("series AS stream", "ordinal", "event_type = 'error' AS recovery", _SEQ)


_SEQ = """CASE WHEN event_id % 97 = 33 THEN NULL ELSE row_number() OVER (PARTITION BY series ORDER BY event_id) + CASE event_id % 97 WHEN 0 THEN 3 WHEN 50 THEN -1 WHEN 70 THEN -4 ELSE 0 END END AS seq"""


def level_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Executed, removed and added volume of each level; a decrease is explained by trades not yet seen in the book."""
    taken = F.when(F.col("taker_side") == "yes", "no").otherwise("yes")
    trades = view(spark, d, "trades").select("event_id", "market", taken.alias("side"), S.yes_price_of(taken, F.col("price")).alias("price"), F.col("size").alias("traded"), F.lit(0).cast(S.SIZE).alias("delta"))
    rows = view(spark, d, "deltas").select("event_id", "market", "side", "price", F.lit(0).cast(S.SIZE).alias("traded"), "delta").unionByName(trades)
    return folds.reconciled(rows, ["market", "side", "price"])


def range_trades(spark: SparkSession, d: str) -> DataFrame:
    """For every delta the trades of the day after it that took its ladder at its price or a better one."""
    taken = F.when(F.col("taker_side") == "yes", "no").otherwise("yes")
    trades = view(spark, d, "trades").select("market", taken.alias("side"), S.yes_price_of(taken, F.col("price")).alias("at_price"), "ms", "size")
    probes = view(spark, d, "deltas").select("event_id", "market", "side", "price", "ms")
    key = ["market", "side", "price"]
    # a trade counts for every asked price that is no better than its own: prices lie on the tick grid, so those are few
    hits = trades.join(probes.select(*key).distinct(), ["market", "side"]).where("at_price >= price").groupBy(*key, "ms").agg(F.count("*").alias("k"), F.sum("size").alias("v"))
    over = f"OVER (PARTITION BY {', '.join(key)} ORDER BY ms)"
    runs = hits.selectExpr(*key, "ms", f"sum(k) {over} AS n", f"CAST(sum(v) {over} AS DECIMAL(24,6)) AS volume")
    asked = probes.select("event_id", *key, F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("ms")), F.struct(F.lit(1).alias("sign"), (F.col("ms") + DAY).alias("ms")))).alias("e")).select("event_id", *key, "e.*")
    seen = asof_join(asked, runs, key, "ms", ["n", "volume"])
    total = lambda c: F.sum(F.col("sign") * F.coalesce(c, F.lit(0)))
    return seen.groupBy("event_id").agg(total("n").cast("long").alias("n"), total("volume").cast(S.SIZE).alias("volume"))


def depth_ahead(spark: SparkSession, d: str) -> DataFrame:
    """At every applied delta's instant: better levels, their size, and the size at its own price, on its own ladder."""
    intervals = book.level_intervals(view(spark, d, "applied"), view(spark, d, "resets"))
    asked = view(spark, d, "applied").where("ok").select("event_id", "market", "side", "price", "ms")
    level = ["market", "side"]
    opened = intervals.select(*level, F.col("price").alias("p"), F.col("from_ms").alias("ms"), F.col("size").alias("v"), F.lit(1).alias("k"))
    closed = intervals.where("to_ms IS NOT NULL").select(*level, F.col("price").alias("p"), F.col("to_ms").alias("ms"), (-F.col("size")).alias("v"), F.lit(-1).alias("k"))
    better, same = F.col("p") > F.col("price"), F.col("p") == F.col("price")
    changes = opened.unionByName(closed).join(asked.select(*level, "price").distinct(), level).where("p >= price").groupBy(*level, "price", "ms").agg(
        F.sum(F.when(better, F.col("v")).otherwise(0)).alias("bv"), F.sum(F.when(better, F.col("k")).otherwise(0)).alias("bk"), F.sum(F.when(same, F.col("v")).otherwise(0)).alias("sv"))
    over = "OVER (PARTITION BY market, side, price ORDER BY ms)"
    runs = changes.selectExpr(*level, "price", "ms", f"CAST(sum(bv) {over} AS DECIMAL(24,6)) AS better_size", f"sum(bk) {over} AS better_levels", f"CAST(sum(sv) {over} AS DECIMAL(24,6)) AS same_size")
    found = asof_join(asked, runs, [*level, "price"], "ms", ["better_size", "better_levels", "same_size"])
    # a delta of nothing at an empty level may come before any change of its ladder
    return found.select("event_id", *[F.coalesce(c, F.lit(0)).cast(runs.schema[c].dataType).alias(c) for c in ("better_levels", "better_size", "same_size")])


def ladder_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three best levels of each side of every last book on the yes scale: bids from the top, asks from the bottom."""
    last = book.level_intervals(view(spark, d, "applied"), view(spark, d, "resets")).where("to_ms IS NULL")
    ranked = last.selectExpr("market", "side", "price", "size", "row_number() OVER (PARTITION BY market, side ORDER BY price DESC) AS place").where("place <= 3")
    return ranked.select("market", F.when(F.col("side") == "yes", "bid").otherwise("ask").alias("ladder"), S.yes_price_of(F.col("side"), F.col("price")).alias("price"), "size", "place")


def book_diff(spark: SparkSession, d: str) -> DataFrame:
    """Levels that differ between each market's book at its middle instant and its last one."""
    intervals = book.level_intervals(view(spark, d, "applied"), view(spark, d, "resets"))
    middle = view(spark, d, "ev").groupBy("market").agg(F.floor((F.min("ms") + F.max("ms")) / 2).cast("long").alias("t"))
    a = intervals.join(middle, "market").where("from_ms <= t AND (to_ms IS NULL OR to_ms > t)").select("market", "side", "price", F.col("size").alias("then_size"))
    b = intervals.where("to_ms IS NULL").select("market", "side", "price", F.col("size").alias("now_size"))
    return a.join(b, ["market", "side", "price"], "full_outer").where(~F.col("then_size").eqNullSafe(F.col("now_size")))


def _fills(spark: SparkSession, d: str, mids: DataFrame) -> DataFrame:
    """Trades as fills, with the book in force and their contract's ticker."""
    trades = view(spark, d, "trades").selectExpr("event_id", "market", "ms", "CASE taker_side WHEN 'yes' THEN 'buy' ELSE 'sell' END AS action", "price", "size AS qty",
        "CASE WHEN event_id % 3 = 0 THEN 'maker' ELSE 'taker' END AS liquidity", "CASE event_id % 4 WHEN 0 THEN 'queue_exhausted' WHEN 1 THEN 'price_through' ELSE 'crossed' END AS reason")
    return asof_join(trades, mids, ["market"], "ms", ["mid", "bid", "ask", "bid_size", "ask_size"])


def _signed(later, earlier):
    """Gain of a buyer, or of a seller."""
    return F.when(F.col("action") == "buy", later - earlier).otherwise(earlier - later).cast("decimal(14,6)")


def markouts(spark: SparkSession, d: str) -> DataFrame:
    return _markouts(spark, d, _held_mids(spark, d))


def _markouts(spark: SparkSession, d: str, mids: DataFrame) -> DataFrame:
    """Of each fill and horizon: what was captured against the mid, the markout, the mid's drift, and dollars.

    Unknown mids are null, and so is what lies beyond the market's last change.
    """
    until = view(spark, d, "ev").groupBy("market").agg(F.max("ms").alias("until"))
    fills = _fills(spark, d, mids).select("event_id", "market", "ms", "action", "price", "qty", F.col("mid").alias("mid_at"))
    asked = fills.select("*", F.explode(F.array(*[F.lit(h).cast("long") for h in HORIZONS])).alias("horizon_ms")).join(until, "market").withColumn("ms", F.col("ms") + F.col("horizon_ms") * UNIT)
    found = asof_join(asked, mids.select("market", "ms", "mid"), ["market"], "ms", ["mid"], F.col("until"))
    out = _signed(F.col("mid"), F.col("price"))
    return found.select("event_id", "horizon_ms", _signed(F.col("mid_at"), F.col("price")).alias("capture"), out.alias("markout"), _signed(F.col("mid"), F.col("mid_at")).alias("drift"), (out * F.col("qty").cast("decimal(16,2)")).cast("decimal(28,8)").alias("dollars"))


def _mean(total, n):
    return F.round(F.try_divide(total.cast("double"), n.cast("double")), 6).cast("decimal(18,6)")


def markout_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = markouts(spark, d)
    both = F.col("drift").isNotNull() & F.col("capture").isNotNull()  # implies a markout
    g = rows.groupBy("horizon_ms").agg(
        F.count("markout").alias("observations"), F.count_if(F.col("markout").isNull()).alias("unobserved"), F.sum("markout").alias("total"), F.median(F.col("markout").cast("double")).alias("med"), F.sum("dollars").alias("dollars"),
        F.count_if(both).alias("k"), F.sum(F.when(both, F.col("capture"))).alias("c"), F.sum(F.when(both, F.col("drift"))).alias("dr"), F.count_if(both & (F.col("drift") < 0)).alias("adverse"))
    return g.select("horizon_ms", "observations", "unobserved", _mean(F.col("total"), F.col("observations")).alias("mean"), F.round("med", 6).cast("decimal(18,6)").alias("median"), F.col("dollars").cast("decimal(28,6)").alias("dollars"),
        _mean(F.col("c"), F.col("k")).alias("capture"), _mean(F.col("dr"), F.col("k")).alias("drift"), _mean(F.col("c") + F.col("dr"), F.col("k")).alias("edge"), _mean(F.col("adverse"), F.col("k")).alias("adverse_rate"))


def fill_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Fills by each of ten dimensions, in one pass: each fill meets its ten buckets."""
    tickers = view(spark, d, "markets").select("market", "ticker")
    mids = _held_mids(spark, d)
    later = _markouts(spark, d, mids).where(F.col("horizon_ms") == BUCKET_HORIZON).select("event_id", "markout", "drift")
    rows = _fills(spark, d, mids).join(tickers, "market").join(later, "event_id", "left")
    t, f = F.col("ticker"), lambda c: F.col(c).cast("double")
    dims = {
        "market": t, "event": S.event_of(t), "series": S.series_of(t), "hour_utc": S.hour_utc(F.col("ms")), "days_to_event_date": S.days_to_event(t, F.col("ms")), "spread": S.spread_bucket(F.col("ask") - F.col("bid")),
        "depth_1": S.depth_bucket(F.col("bid_size") + F.col("ask_size")), "imbalance_1": S.imbalance_bucket((f("bid_size") - f("ask_size")) / (f("bid_size") + f("ask_size"))), "liquidity": F.col("liquidity"), "fill_reason": F.col("reason"),
    }
    q, none = F.col("qty").cast("decimal(16,2)"), F.lit(None)
    taker_fee = S.fee(F.col("liquidity"), F.lit("0.07"), none, F.lit("0"), F.lit(True), F.col("qty"), F.col("price"))
    captured = F.when(F.col("liquidity") == "maker", _signed(F.col("mid"), F.col("price")))
    long = rows.select("qty", (q * F.col("price")).cast("decimal(28,8)").alias("notional"), taker_fee.alias("fee"), captured.alias("captured"), "markout", "drift", F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("bucket")) for k, v in dims.items()])).alias("x"))
    mean = lambda c: _mean(F.sum(c), F.count(c))
    return long.groupBy("x.dimension", "x.bucket").agg(
        F.count("*").alias("fills"), F.sum("qty").cast("decimal(28,6)").alias("contracts"), F.sum("notional").cast("decimal(28,6)").alias("notional"), F.sum("fee").cast("decimal(28,6)").alias("fees"),
        mean("captured").alias("spread_captured"), mean("markout").alias("markout"), mean("drift").alias("mid_drift"), _mean(F.count_if(F.col("drift") < 0), F.count("drift")).alias("adverse_rate"),
    )


_SPANS = "spans AS (SELECT market, epoch, side, price, post, event_id AS a, coalesce(lead(event_id) OVER (PARTITION BY market, epoch, side, price ORDER BY event_id), 1000000000000) AS b FROM applied WHERE ok)"
_TOUCH = f"""{_SPANS}, touch AS (SELECT e.event_id, e.market, e.ms, max(s.price) FILTER (WHERE s.side = 'yes') AS bid, arg_max(s.post, s.price) FILTER (WHERE s.side = 'yes') AS bid_size,
    CAST(1 - max(s.price) FILTER (WHERE s.side = 'no') AS DECIMAL(12,6)) AS ask, arg_max(s.post, s.price) FILTER (WHERE s.side = 'no') AS ask_size
    FROM applied e LEFT JOIN spans s ON e.ok AND s.market = e.market AND s.epoch = e.epoch AND s.post > 0 AND e.event_id >= s.a AND e.event_id < s.b GROUP BY e.event_id, e.market, e.ms)"""
_MIDS = f"""{_TOUCH}, stated AS (SELECT market, ms, arg_max(struct_pack(bid := bid, ask := ask, bid_size := bid_size, ask_size := ask_size), event_id) AS s FROM (SELECT * FROM touch UNION ALL BY NAME SELECT event_id, market, ms FROM resets) u GROUP BY market, ms),
    priced AS (SELECT market, ms, s.bid AS bid, s.ask AS ask, s.bid_size AS bid_size, s.ask_size AS ask_size, CAST((s.bid + s.ask) * 0.5 AS DECIMAL(12,6)) AS mid,
      round((CAST(s.bid AS DOUBLE) * CAST(s.ask_size AS DOUBLE) + CAST(s.ask AS DOUBLE) * CAST(s.bid_size AS DOUBLE)) / (CAST(s.bid_size AS DOUBLE) + CAST(s.ask_size AS DOUBLE)), 6) AS micro FROM stated),
    mids AS (SELECT * EXCLUDE (wm, wi, k) FROM (SELECT *, lag(mid) OVER w AS wm, lag(micro) OVER w AS wi, row_number() OVER w AS k FROM priced WINDOW w AS (PARTITION BY market ORDER BY ms)) x WHERE k = 1 OR wm IS DISTINCT FROM mid OR wi IS DISTINCT FROM micro)"""
_MARKS = f"""{_MIDS}, f AS (SELECT t.event_id, t.market, t.ms, CASE t.taker_side WHEN 'yes' THEN 1 ELSE -1 END AS sg, t.price, t.size AS qty, m.mid, m.bid, m.ask, m.bid_size, m.ask_size FROM trades t ASOF LEFT JOIN mids m ON m.market = t.market AND t.ms >= m.ms),
    asked AS (SELECT f.*, h.h, f.ms + h.h * {UNIT} AS at, u.until FROM f, (VALUES {", ".join(f"(CAST({h} AS BIGINT))" for h in HORIZONS)}) h(h), (SELECT market, max(ms) AS until FROM ev GROUP BY market) u WHERE u.market = f.market),
    marks AS (SELECT a.event_id, a.h AS horizon_ms, CAST(a.sg * (a.mid - a.price) AS DECIMAL(14,6)) AS capture, CASE WHEN a.at <= a.until THEN CAST(a.sg * (m.mid - a.price) AS DECIMAL(14,6)) END AS markout,
      CASE WHEN a.at <= a.until THEN CAST(a.sg * (m.mid - a.mid) AS DECIMAL(14,6)) END AS drift, CASE WHEN a.at <= a.until THEN CAST(CAST(a.sg * (m.mid - a.price) AS DECIMAL(10,6)) * CAST(a.qty AS DECIMAL(16,2)) AS DECIMAL(28,8)) END AS dollars
      FROM asked a ASOF LEFT JOIN mids m ON m.market = a.market AND a.at >= m.ms)"""
_AVG = "CAST(round(CAST({} AS DOUBLE) / nullif(CAST({} AS DOUBLE), 0), 6) AS DECIMAL(18,6))"
_ACTS = """acts AS (SELECT e.event_id, e.market, e.epoch, e.delta, CAST(coalesce((SELECT sum(p.delta) FROM epochs p WHERE p.market = e.market AND p.epoch = e.epoch AND p.side = e.side AND p.price = e.price AND p.event_id < e.event_id), 0) AS DECIMAL(24,6)) AS pre FROM epochs e),
    bad AS (SELECT market, epoch, min(event_id) AS first_bad FROM acts WHERE pre + delta < 0 GROUP BY market, epoch),
    acted AS (SELECT a.event_id, a.market, first_bad IS NULL OR event_id < first_bad AS applied, CASE WHEN first_bad IS NULL OR event_id <= first_bad THEN pre END AS pre, CASE WHEN first_bad IS NULL OR event_id <= first_bad THEN CAST(pre + delta AS DECIMAL(24,6)) END AS post,
      CASE WHEN event_id > first_bad THEN NULL WHEN event_id = first_bad OR delta = 0 AND pre > 0 THEN 'unknown' WHEN pre + delta = 0 THEN 'delete' WHEN pre = 0 THEN 'insert' WHEN delta > 0 THEN 'increase' ELSE 'decrease' END AS level_action
      FROM acts a LEFT JOIN bad b ON b.market = a.market AND b.epoch = a.epoch)"""
_DAYSPANS = """iv AS (SELECT s.market, s.side, s.price, s.post AS size, a.ms AS from_ms, coalesce(z.ms, (SELECT min(c.ms) FROM applied c WHERE c.cut = c.event_id AND c.market = s.market AND c.epoch = s.epoch),
    (SELECT min(r.ms) FROM resets r WHERE r.market = s.market AND r.event_id > s.a)) AS to_ms FROM spans s JOIN ev a ON a.event_id = s.a LEFT JOIN ev z ON z.event_id = s.b WHERE s.post > 0)"""

ORACLES: dict[str, str] = {
    "delta_apply": f"WITH {_ACTS} SELECT event_id, applied, pre, post, level_action FROM acted",
    "event_time_rows": f"""WITH {_ACTS}, {_TOUCH} SELECT a.event_id, a.market, applied, pre, post, level_action, bid, bid_size, ask, ask_size FROM acted a JOIN touch t ON t.event_id = a.event_id
        UNION ALL SELECT event_id, market, true, NULL, NULL, 'seed', NULL, NULL, NULL, NULL FROM resets""",
    "replay_verify": f"""SELECT market, count(*) AS checked, count(*) FILTER (WHERE ok AND event_id % 35 <> 0) AS matched, count(*) FILTER (WHERE ok AND event_id % 35 = 0) AS mismatched, count(*) FILTER (WHERE NOT ok) AS unreached FROM applied WHERE event_id % {CHECK} = 0 GROUP BY market""",
    "grid_post_event": f"""WITH {_TOUCH}, last AS (SELECT market, ms, max(event_id) AS event_id FROM touch GROUP BY market, ms), days AS (SELECT market, unnest(generate_series(CAST(ceil(min(ms) / {DAY}.0) AS BIGINT), max(ms) // {DAY})) * {DAY} AS bucket_ms FROM touch GROUP BY market)
        SELECT d.market, bucket_ms, l.event_id AS state_of, bid, ask FROM days d ASOF JOIN last l ON l.market = d.market AND d.bucket_ms <= l.ms JOIN touch t ON t.event_id = l.event_id""",
    "mid_changes": f"WITH {_MIDS} SELECT market, ms, mid, micro FROM mids",
    "recent_activity": f"""WITH {_MIDS}, mv AS (SELECT market, ms FROM (SELECT *, lag(bid) OVER w AS b, lag(ask) OVER w AS a, row_number() OVER w AS k FROM mids WINDOW w AS (PARTITION BY market ORDER BY ms)) x WHERE k = 1 OR b IS DISTINCT FROM bid OR a IS DISTINCT FROM ask)
        SELECT t.event_id, (SELECT count(*) FROM trades x WHERE x.market = t.market AND x.ms BETWEEN t.ms - {WINDOW} AND t.ms) AS trades, (SELECT count(*) FROM deltas x WHERE x.market = t.market AND x.ms BETWEEN t.ms - {WINDOW} AND t.ms) AS deltas,
        (SELECT count(*) FROM mv x WHERE x.market = t.market AND x.ms BETWEEN t.ms - {WINDOW} AND t.ms) AS moves FROM trades t""",
    "ticker_mismatches": f"""WITH RECURSIVE {_MIDS}, mm AS (SELECT DISTINCT t.market, t.ms FROM trades t ASOF JOIN mids m ON m.market = t.market AND t.ms >= m.ms WHERE m.bid <> t.price),
        kept AS (SELECT market, min(ms) AS ms FROM mm GROUP BY market UNION ALL SELECT k.market, min(m.ms) FROM kept k JOIN mm m ON m.market = k.market AND m.ms >= k.ms + {COOLDOWN} GROUP BY k.market) SELECT market, ms FROM kept""",
    "sequence_verdicts": f"""WITH RECURSIVE fr AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ordinal) AS rn FROM (SELECT series AS stream, ordinal, event_type = 'error' AS recovery, {_SEQ} FROM ev) f),
        walk AS (SELECT stream, 0 AS rn, CAST(NULL AS BIGINT) AS top, false AS bad, CAST(NULL AS VARCHAR) AS verdict, CAST(0 AS BIGINT) AS ordinal FROM (SELECT DISTINCT stream FROM fr) s UNION ALL
          SELECT f.stream, f.rn, CASE WHEN recovery THEN seq WHEN bad OR seq IS NULL THEN top WHEN top IS NULL OR seq = top + 1 THEN seq ELSE top END, NOT recovery AND (bad OR coalesce(seq > top + 1, false)),
            CASE WHEN recovery THEN 'recovered' WHEN seq IS NULL THEN 'unsequenced' WHEN bad THEN 'degraded' WHEN top IS NULL THEN 'first' WHEN seq = top + 1 THEN 'ok' WHEN seq = top THEN 'duplicate' WHEN seq < top THEN 'out_of_order' ELSE 'gap' END, f.ordinal
          FROM walk w JOIN fr f ON f.stream = w.stream AND f.rn = w.rn + 1)
        SELECT verdict, count(*) AS n, min(ordinal) AS first_at, max(ordinal) AS last_at FROM walk WHERE rn > 0 GROUP BY verdict""",
    "level_reconcile": """WITH RECURSIVE u AS (SELECT event_id, market, side, price, CAST(0 AS DECIMAL(24,6)) AS traded, delta FROM deltas
          UNION ALL SELECT event_id, market, 'no', CAST(1 - price AS DECIMAL(12,6)), size, 0 FROM trades WHERE taker_side = 'yes' UNION ALL SELECT event_id, market, 'yes', price, size, 0 FROM trades WHERE taker_side = 'no'),
        r AS (SELECT *, row_number() OVER (PARTITION BY market, side, price ORDER BY event_id) AS rn FROM u),
        w AS (SELECT DISTINCT market, side, price, 0 AS rn, CAST(0 AS DECIMAL(24,6)) AS executed, CAST(0 AS DECIMAL(24,6)) AS removed, CAST(0 AS DECIMAL(24,6)) AS added, CAST(0 AS DECIMAL(24,6)) AS unreconciled FROM r UNION ALL
          SELECT w.market, w.side, w.price, r.rn, CAST(executed + traded AS DECIMAL(24,6)), CAST(removed + greatest(0, -delta - unreconciled) AS DECIMAL(24,6)), CAST(added + greatest(0, delta) AS DECIMAL(24,6)), CAST(greatest(0, unreconciled + traded - greatest(0, -delta)) AS DECIMAL(24,6))
          FROM w JOIN r ON r.market = w.market AND r.side = w.side AND r.price = w.price AND r.rn = w.rn + 1)
        SELECT market, side, price, arg_max(executed, rn) AS executed, arg_max(removed, rn) AS removed, arg_max(added, rn) AS added, arg_max(unreconciled, rn) AS unreconciled FROM w GROUP BY market, side, price""",
    "range_trades": f"""SELECT p.event_id, count(t.event_id) AS n, CAST(coalesce(sum(t.size), 0) AS DECIMAL(24,6)) AS volume FROM deltas p LEFT JOIN trades t ON t.market = p.market AND t.ms > p.ms AND t.ms <= p.ms + {DAY}
        AND (p.side = 'yes' AND t.taker_side = 'no' AND t.price >= p.price OR p.side = 'no' AND t.taker_side = 'yes' AND 1 - t.price >= p.price) GROUP BY p.event_id""",
    "depth_ahead": f"""WITH {_SPANS}, {_DAYSPANS} SELECT e.event_id, count(i.price) FILTER (WHERE i.price > e.price) AS better_levels, CAST(coalesce(sum(i.size) FILTER (WHERE i.price > e.price), 0) AS DECIMAL(24,6)) AS better_size, CAST(coalesce(sum(i.size) FILTER (WHERE i.price = e.price), 0) AS DECIMAL(24,6)) AS same_size
        FROM applied e LEFT JOIN iv i ON i.market = e.market AND i.side = e.side AND i.from_ms <= e.ms AND coalesce(i.to_ms > e.ms, true) WHERE e.ok GROUP BY e.event_id""",
    "ladder_topk": f"""WITH {_SPANS}, {_DAYSPANS} SELECT market, ladder, price, size, place FROM (SELECT market, 'bid' AS ladder, price, size, row_number() OVER (PARTITION BY market ORDER BY price DESC) AS place FROM iv WHERE to_ms IS NULL AND side = 'yes'
        UNION ALL SELECT market, 'ask', CAST(1 - price AS DECIMAL(12,6)), size, row_number() OVER (PARTITION BY market ORDER BY 1 - price) FROM iv WHERE to_ms IS NULL AND side = 'no') l WHERE place <= 3""",
    "book_diff": f"""WITH {_SPANS}, {_DAYSPANS}, mid AS (SELECT market, (min(ms) + max(ms)) // 2 AS t FROM ev GROUP BY market) SELECT * FROM (SELECT i.market, side, price, max(CASE WHEN from_ms <= t AND coalesce(to_ms > t, true) THEN size END) AS then_size, max(CASE WHEN to_ms IS NULL THEN size END) AS now_size
        FROM iv i JOIN mid m ON m.market = i.market GROUP BY i.market, side, price) x WHERE then_size IS DISTINCT FROM now_size""",
    "markouts": f"WITH {_MARKS} SELECT event_id, horizon_ms, capture, markout, drift, dollars FROM marks",
    "markout_summary": f"""WITH {_MARKS}, m AS (SELECT *, drift IS NOT NULL AND capture IS NOT NULL AS b FROM marks) SELECT horizon_ms, count(markout) AS observations, count(*) - count(markout) AS unobserved, {_AVG.format("sum(markout)", "count(markout)")} AS mean,
        CAST(round(median(CAST(markout AS DOUBLE)), 6) AS DECIMAL(18,6)) AS median, CAST(sum(dollars) AS DECIMAL(28,6)) AS dollars, {_AVG.format("sum(capture) FILTER (WHERE b)", "count(*) FILTER (WHERE b)")} AS capture, {_AVG.format("sum(drift) FILTER (WHERE b)", "count(*) FILTER (WHERE b)")} AS drift,
        {_AVG.format("sum(capture + drift) FILTER (WHERE b)", "count(*) FILTER (WHERE b)")} AS edge, {_AVG.format("count(*) FILTER (WHERE b AND drift < 0)", "count(*) FILTER (WHERE b)")} AS adverse_rate FROM m GROUP BY horizon_ms""",
}

ORACLES["fill_breakdown"] = f"""WITH {_MARKS}, x AS (SELECT f.*, f.event_id % 3 = 0 AS maker, m.ticker, string_split(m.ticker, '-') AS ps, k.markout, k.drift, (f.ask - f.bid) * 100 AS sp, f.bid_size + f.ask_size AS dp,
      (CAST(f.bid_size AS DOUBLE) - CAST(f.ask_size AS DOUBLE)) / (CAST(f.bid_size AS DOUBLE) + CAST(f.ask_size AS DOUBLE)) AS im FROM f JOIN markets m ON m.market = f.market LEFT JOIN marks k ON k.event_id = f.event_id AND k.horizon_ms = {BUCKET_HORIZON}),
    y AS (SELECT x.*, c.mo FROM x LEFT JOIN (SELECT unnest(['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC']) AS mon, unnest(range(1, 13)) AS mo) c ON c.mon = substr(ps[2], 3, 3)),
    z AS (SELECT qty, maker, price, sg, mid, markout, drift, unnest([struct_pack(dimension := 'market', bucket := ticker), struct_pack(dimension := 'event', bucket := ps[1] || '-' || ps[2]), struct_pack(dimension := 'series', bucket := ps[1]),
      struct_pack(dimension := 'hour_utc', bucket := strftime(make_timestamp(ms * 1000), '%H:00')),
      struct_pack(dimension := 'days_to_event_date', bucket := CASE WHEN mo IS NULL THEN 'unknown' ELSE 'D+' || (date_diff('day', CAST(make_timestamp(ms * 1000) AS DATE), make_date(2024, mo, 1)) + CAST(substr(ps[2], 6, 2) AS INT) - 1) END),
      struct_pack(dimension := 'spread', bucket := coalesce((SELECT min_by(l, e) FROM (VALUES (1, '<=1c'), (2, '2c'), (3, '3c'), (5, '4-5c'), (10, '6-10c'), (999, '>10c')) v(e, l) WHERE sp <= e), 'unknown')),
      struct_pack(dimension := 'depth_1', bucket := coalesce((SELECT min_by(l, e) FROM (VALUES (50, '<=50'), (200, '51-200'), (1000, '201-1000'), (1000000000, '>1000')) v(e, l) WHERE dp <= e), 'unknown')),
      struct_pack(dimension := 'imbalance_1', bucket := CASE WHEN im IS NULL THEN 'unknown' ELSE ['[-1.0,-0.6]', '(-0.6,-0.2]', '(-0.2,0.2)', '[0.2,0.6)', '[0.6,1.0]'][1 + CAST(im > -0.6 AS INT) + CAST(im > -0.2 AS INT) + CAST(im >= 0.2 AS INT) + CAST(im >= 0.6 AS INT)] END),
      struct_pack(dimension := 'liquidity', bucket := CASE WHEN maker THEN 'maker' ELSE 'taker' END), struct_pack(dimension := 'fill_reason', bucket := ['queue_exhausted', 'price_through', 'crossed', 'crossed'][event_id % 4 + 1])]) AS d FROM y)
    SELECT d.dimension AS dimension, d.bucket AS bucket, count(*) AS fills, CAST(sum(qty) AS DECIMAL(28,6)) AS contracts, CAST(sum(CAST(qty AS DECIMAL(16,2)) * price) AS DECIMAL(28,6)) AS notional,
      CAST(sum(CASE WHEN maker THEN 0 ELSE ceil(CAST(qty AS DECIMAL(10,2)) * CAST(price AS DECIMAL(4,2)) * CAST(1 - price AS DECIMAL(4,2)) * CAST(0.07 AS DECIMAL(4,2)) * 100) / 100 END) AS DECIMAL(28,6)) AS fees,
      {_AVG.format("sum(sg * (mid - price)) FILTER (WHERE maker)", "count(mid) FILTER (WHERE maker)")} AS spread_captured, {_AVG.format("sum(markout)", "count(markout)")} AS markout, {_AVG.format("sum(drift)", "count(drift)")} AS mid_drift,
      {_AVG.format("count(*) FILTER (WHERE drift < 0)", "count(drift)")} AS adverse_rate FROM z GROUP BY ALL"""
ORACLES["probe_eligibility"] = f"""WITH {_SPANS}, {_DAYSPANS}, tops AS (SELECT market, max(price) FILTER (WHERE side = 'yes') AS bid, arg_max(size, price) FILTER (WHERE side = 'yes') AS bs, 1 - max(price) FILTER (WHERE side = 'no') AS ask, arg_max(size, price) FILTER (WHERE side = 'no') AS asz FROM iv WHERE to_ms IS NULL GROUP BY market),
    bad AS (SELECT DISTINCT a.market FROM applied a JOIN (SELECT market, max(epoch) AS me FROM applied GROUP BY market) l ON l.market = a.market AND l.me = a.epoch WHERE cut IS NOT NULL),
    fl AS (SELECT e.market, count(*) FILTER (WHERE event_type IN ('view', 'click', 'signup')) AS deltas, count(*) FILTER (WHERE event_type = 'purchase') AS trades FROM ev e GROUP BY e.market),
    j AS (SELECT fl.*, bid, bs, ask, asz, m.market IS NOT NULL AND fl.market % 2 = 0 AND (lower(trim(coalesce(result, ''))) IN ('yes', 'no', 'void', 'canceled') OR lower(trim(coalesce(status, ''))) IN ('closed', 'determined', 'settled')) AS shut, fl.market IN (SELECT market FROM bad) AS broken
      FROM fl LEFT JOIN tops t ON t.market = fl.market LEFT JOIN markets m ON m.market = fl.market),
    r AS (SELECT *, coalesce((SELECT min_by(n, i) FROM (VALUES (1, 'no_book', market % 13 = 0), (2, 'book_invalid', broken), (3, 'not_active', shut), (4, 'not_two_sided', bid IS NULL OR ask IS NULL), (5, 'no_touch_size', bs <= 0), (6, 'mid_out_of_band', bid + ask < 0.4 OR bid + ask > 1.6),
      (7, 'too_close_to_close', market < 9), (8, 'no_recent_activity', deltas % 23 < 5)) v(i, n, hit) WHERE hit), 'eligible') AS reason FROM j)
    SELECT market, reason, CASE reason WHEN 'eligible' THEN (CASE WHEN bs + asz >= 100 THEN 'high' ELSE 'low' END) || '_depth/' || (CASE WHEN trades >= 3 THEN 'high' ELSE 'low' END) || '_flow' END AS stratum FROM r"""
ORACLES["stream_books"] = f"WITH {_TOUCH} SELECT event_id, market, bid, bid_size, ask, ask_size FROM touch UNION ALL SELECT event_id, market, NULL, NULL, NULL, NULL FROM resets"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        delta_apply, event_time_rows, replay_verify, grid_post_event, mid_changes, recent_activity, ticker_mismatches, sequence_verdicts, level_reconcile, range_trades, depth_ahead, ladder_topk, book_diff,
        markouts, markout_summary, fill_breakdown,
    )
    return {f.__name__: f for f in own}
