"""Queries of the scalar functions, and oracles written from the functions' definitions in other terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import scalar as S
from tidebook.tables import load, view

DAY = 86_400_000
#: Fixed values of the given tables' fee schedule: type, from when, rate, maker's fee a contract, rounded up to cents, verified.
SCHEDULE = (
    ("quadratic", 0, "0.07", "0", True, True), ("quadratic", 900_000_000_000, "0.035", "0", True, True),
    ("quadratic_with_maker_fees", 0, "0.07", "0.0025", True, True), ("quadratic_with_maker_fees", 850_000_000_000, "0.06", "0.002", False, True),
    ("flat", 0, "0.01", "0.01", False, False),
)
#: Parameters of the queries below.
STATUSES, SELECTED = ("open", "closed"), ("initialized", "active", "inactive", "determined", "finalized", "unknown")
LIMITS = {"resting": 400, "resting_per_market": 12, "probes_per_series": 18, "order_size": 5, "position": 400, "exposure": 2500, "fills": 11, "orders": 95}


def _decimal(text: str) -> str:
    return f"CAST({text} AS DECIMAL(12,6))"


def lifecycle_state(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "markets").withColumn("state", S.lifecycle_state(F.col("status"), F.col("result")))
    payout, basis = S.yes_payout(F.col("state"), F.col("settlement_value"), F.col("notional_value"))
    return rows.select("market", "state", S.is_determined(F.col("state")).alias("determined"), payout.alias("payout"), basis.alias("basis"))


def ticker_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ticker")
    rows = view(spark, d, "fills").groupBy("market").agg(F.max("ms").alias("ms")).join(view(spark, d, "markets"), "market")
    return rows.select("market", S.event_of(t).alias("event"), S.series_of(t).alias("series"), S.days_to_event(t, F.col("ms")).alias("days"), S.hour_utc(F.col("ms")).alias("hour_utc"))


def fixed_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "trades").select(
        F.when(F.col("event_id") % 9 != 0, F.col("price") - F.lit("0.05").cast("decimal(4,2)")).alias("spread"), F.when(F.col("event_id") % 8 != 0, F.col("size") * 5).alias("depth"),
        F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 11 - 5) / 5.0).alias("imbalance"),
    )
    return rows.groupBy(S.spread_bucket(F.col("spread")).alias("spread"), S.depth_bucket(F.col("depth")).alias("depth"), S.imbalance_bucket(F.col("imbalance")).alias("imbalance")).agg(F.count("*").alias("n"))


def fee_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Each fill's fee with its provenance: the schedule entry in force at the fill; an unknown fee is no zero fee."""
    schedule = spark.createDataFrame(list(SCHEDULE), "fee_type string, since long, rate string, maker string, up boolean, verified boolean")
    entries = schedule.groupBy("fee_type").agg(F.array_sort(F.collect_list(F.struct("since", "rate", "maker", "up", "verified"))).alias("entries"))
    rows = view(spark, d, "fills").withColumn("liquidity", F.when(F.col("l_linestatus") == "O", "maker").otherwise("taker"))
    rows = rows.join(view(spark, d, "markets").select("market", "fee_type", "fee_multiplier", F.lit(True).alias("stated")).where("market % 10 <> 9"), "market", "left").join(F.broadcast(entries), "fee_type", "left")
    rows = rows.withColumn("e", F.expr("element_at(filter(entries, x -> x.since <= ms), -1)"))
    reason = S.first_reason(
        ("market_state_missing", F.col("stated").isNull()), ("fee_type_missing", F.col("fee_type").isNull()), ("schedule_entry_missing", F.col("e").isNull()),
        ("schedule_entry_unverified", ~F.col("e.verified")), otherwise="known",
    )
    amount = S.fee(F.col("liquidity"), F.col("e.rate"), F.col("fee_multiplier"), F.col("e.maker"), F.col("e.up"), F.col("qty"), F.col("price"))
    rows = rows.withColumn("reason", reason)
    return rows.select("order_id", "line", "market", "qty", "price", "ms", "reason", F.when(F.col("reason") == "known", amount).alias("fee"))


def canonical_size(spark: SparkSession, d: str) -> DataFrame:
    x = (F.col("event_id") * 5).cast("decimal(20,7)") / F.lit("10000000").cast("decimal(8,0)")
    return load(spark, d, "events").select("event_id", S.canonical(x.cast("decimal(24,7)"), S.SIZE).alias("canonical"))


def ladder_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "deltas").withColumn("order_side", F.when(F.col("event_id") % 3 == 0, "bid").otherwise("ask"))
    side, price = S.public_level(F.col("order_side"), F.col("price"))
    rows = rows.withColumn("book_side", side).withColumn("book_price", price)
    touch = F.when(F.col("event_id") % 5 != 0, F.lit("0.47").cast(S.PRICE))
    yes_price, action = S.yes_equivalent(F.col("side"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell"), F.col("price"))
    return rows.select(
        "event_id", "book_side", "book_price", S.yes_price_of(F.col("book_side"), F.col("book_price")).alias("back"), S.price_to_cents(F.col("price")).alias("cents"),
        S.cents_to_price(S.price_to_cents(F.col("price"))).alias("again"), S.is_better(F.col("order_side"), F.col("price"), F.lit("0.25").cast(S.PRICE)).alias("other_better"),
        S.ticks_from_touch(F.col("order_side"), F.col("price"), touch, touch).alias("ticks"), yes_price.alias("yes_price"), action.alias("yes_action"),
        S.premium(F.col("order_side"), F.col("price"), F.abs("delta")).alias("premium"),
    )


def ts_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "ev").selectExpr("event_id", "CASE event_id % 4 WHEN 0 THEN CAST(ms AS DOUBLE) / 1000 WHEN 1 THEN CAST(ms AS DOUBLE) END AS number",
        "CASE event_id % 4 WHEN 2 THEN date_format(timestamp_millis(ms), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") WHEN 3 THEN CASE WHEN event_id % 8 = 3 THEN '  ' ELSE 'soon' END END AS text")
    return rows.select("event_id", S.epoch_ms(F.col("number"), F.col("text")).alias("ms"), S.empty_to_null(F.trim(F.col("text"))).isNull().alias("blank"), S.numeric_text(F.col("number").cast("decimal(24,3)").cast("string")).alias("as_number"))


def channel_route(spark: SparkSession, d: str) -> DataFrame:
    kinds = [*S.CHANNELS, "heartbeat"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("event_id") % len(kinds) + 1).cast("int"))
    return load(spark, d, "events").select(kind.alias("kind")).groupBy("kind", S.channel_for(F.col("kind")).alias("channel")).agg(F.count("*").alias("n"))


def status_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    asked = F.filter(F.array(*[F.when(F.col("market").bitwiseAND(F.lit(1 << i)) != 0, F.lit(s)) for i, s in enumerate(SELECTED)]), lambda s: s.isNotNull())
    return view(spark, d, "markets").select("market", F.array_join(F.array_sort(S.query_statuses(asked)), ",").alias("statuses"))


def end_reasons(spark: SparkSession, d: str) -> DataFrame:
    end = F.element_at(F.array(*[F.lit(x) for x in ("sigterm", "sigint", "deploy-7", "clean shutdown", "oom", None)]), (F.col("event_id") % 6 + 1).cast("int"))
    return load(spark, d, "events").select(S.reason_for_end(end, F.col("event_id") % 17 == 0).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def json_lists(spark: SparkSession, d: str) -> DataFrame:
    """Levels, source names and affected markets out of JSON texts."""
    rows = view(spark, d, "ev").selectExpr("event_id", "concat('[[\"0.', lpad(CAST(event_id % 90 + 5 AS STRING), 2, '0'), '\",\"', CAST(size AS STRING), '\"],[\"0.01\",\"x\"]]') AS levels",
        "concat('[{\"name\":\"n', event_id % 5, '\"},{\"url\":\"u', event_id % 3, '\"},{\"name\":\" \",\"url\":\"v\"}]') AS sources", "concat('[\"m', market, '\",\"m', market + 1, '\"]') AS affected", "concat('m', event_id % 20) AS asked")
    levels = S.price_levels(F.col("levels"))
    return rows.select("event_id", levels[0]["price"].alias("price"), levels[0]["size"].alias("size"), levels[1]["size"].isNull().alias("no_size"),
        F.array_join(S.source_names(F.col("sources")), "|").alias("names"), S.json_holds(F.col("affected"), F.col("asked")).alias("affects"))


def structural_hash(spark: SparkSession, d: str) -> DataFrame:
    names = ("ticker", "status", "result", "settlement_value", "notional_value", "fee_type", "fee_multiplier")
    return view(spark, d, "markets").select("market", S.structural_hash({n: F.col(n) for n in names}).alias("version"))


def eligibility(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "ev").selectExpr("event_id", "market", "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'open' WHEN 2 THEN 'closed' ELSE 'settled' END AS status", "ms",
        "CASE WHEN event_id % 3 > 0 THEN ms + (event_id % 400) * 1000 END AS open_ms", "CASE WHEN event_id % 4 > 0 THEN ms - (event_id % 700) * 1000 END AS close_ms")
    ok = S.market_eligible(F.col("market"), F.col("status"), F.col("ms"), F.col("open_ms"), F.col("close_ms"), deny=(3, 5, 8), statuses=STATUSES, lead_ms=300_000, retain_ms=600_000)
    return rows.select("event_id", ok.alias("eligible"))


#: Selectors of series: prefixes, categories, allow-list, deny-list.
SELECTORS = {
    "named": {"prefixes": ("KXHIGH",), "allow": ("KXHIGH1", "KXWIND0", "KXRAIN3", "KXNONE"), "deny": ("KXWIND0",)},
    "by_category": {"prefixes": ("KXHIGH", "KXRAIN"), "categories": ("PROMO", "SMALL"), "deny": ("KXHIGH2", "KXRAIN0")},
    "by_prefix": {"prefixes": ("KXHIGH", "KXRAIN"), "deny": ("KXHIGH2", "KXRAIN0")},
    "none": {},
}
SCOPE = 5


def series_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Series that each of four selectors takes, with its scope's cap as a flag."""
    series = view(spark, d, "markets").select(S.series_of(F.col("ticker")).alias("series"), F.substring_index("p_type", " ", 1).alias("category")).distinct()
    taken = F.array(*[F.when(S.series_chosen(F.col("series"), F.col("category"), **of), F.lit(name)) for name, of in SELECTORS.items()])
    chosen = series.select("series", F.explode(F.array_compact(taken)).alias("selector")).distinct()
    counts = chosen.groupBy("selector").agg((F.count("*") > SCOPE).alias("over_scope"))
    return chosen.join(counts, "selector").select("selector", "series", "over_scope")


def latency_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "ev").withColumn("exchange", F.when(F.col("event_id") % 6 != 0, F.col("ms") - (F.col("event_id") % 41 - 4) * 20_000))
    kept = rows.select("series", S.latency_kept(F.col("ms"), F.col("exchange")).alias("delay")).where("delay IS NOT NULL")
    return kept.groupBy("series").agg(F.count("*").alias("n"), F.min("delay").alias("least"), F.max("delay").alias("most"), F.sum("delay").alias("total"))


def probe_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """The first failing reason of every market's last book, with its stratum where it is eligible."""
    from tidebook.plans.market import final_tops

    tops = final_tops(spark, d)
    flow = view(spark, d, "ev").groupBy("market").agg(F.count_if(F.col("event_type").isin("view", "click", "signup")).alias("deltas"), F.count_if(F.col("event_type") == "purchase").alias("trades"), F.max("ms").alias("ms"))
    state = view(spark, d, "markets").select("market", S.lifecycle_state(F.col("status"), F.col("result")).alias("state"))
    rows = flow.join(tops, "market", "left").join(state, "market", "left")
    reason = S.probe_reason(F.col("market") % 13 != 0, F.coalesce("valid", F.lit(True)), F.when(F.col("market") % 2 == 0, F.col("state")), F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("market") * 1000, F.col("deltas") % 23, 0.2, 0.8, 9000)
    place = S.stratum(F.col("bid_size") + F.col("ask_size"), F.col("trades"))
    return rows.select("market", reason.alias("reason")).join(rows.select("market", place.alias("stratum")), "market").select("market", "reason", F.when(F.col("reason") == "eligible", F.col("stratum")).alias("stratum"))


def risk_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Whether each market may be probed, from the account's state over all markets."""
    rows = view(spark, d, "ev").groupBy("market", "series").agg(
        F.count_if(F.col("event_type") == "view").alias("resting"), F.count_if((F.col("event_type") == "error") & (F.col("event_id") % 37 == 0)).alias("in_flight"), F.count_if(F.col("event_type") == "purchase").alias("fills"),
        F.count("*").alias("orders"), F.sum(F.when(F.col("event_type") == "signup", F.col("size")).otherwise(0)).cast(S.SIZE).alias("position"))
    by_series = rows.groupBy("series").agg(F.sum("in_flight").alias("series_in_flight"))
    whole = rows.agg(F.sum(F.col("resting") % 4).alias("all_resting"), F.sum("in_flight").alias("all_in_flight"))
    rows = rows.join(by_series, "series").crossJoin(whole)  # one row
    reason = S.risk_reason(F.col("in_flight"), F.col("resting") % 14, F.col("all_resting") % 401, F.col("all_in_flight"), F.col("series_in_flight") % 20, F.col("position"), F.col("position") * 8, F.col("fills"), F.col("orders"), LIMITS)
    killed = (F.abs("position") > LIMITS["position"]) | (F.col("position") * 8 > LIMITS["exposure"])
    return rows.select("market", reason.alias("reason"), S.first_reason(("private_feed_down", F.col("market") % 29 == 0), ("ambiguous_order_state", F.col("in_flight") > 1), ("risk_limit", killed), otherwise="none").alias("blocking"))


_SCHEDULE = "(VALUES " + ", ".join(f"('{t}', CAST({a} AS BIGINT), CAST({r} AS DECIMAL(4,4)), CAST({m} AS DECIMAL(6,4)), {u}, {v})" for t, a, r, m, u, v in SCHEDULE) + ") s(fee_type, since, rate, maker, up, verified)"
_STATE = """CASE lower(trim(coalesce(result, ''))) WHEN 'yes' THEN 'DETERMINED_YES' WHEN 'no' THEN 'DETERMINED_NO' WHEN 'void' THEN 'VOIDED' WHEN 'canceled' THEN 'VOIDED'
    ELSE CASE WHEN list_contains(['closed', 'determined', 'settled', 'finalized'], lower(trim(status))) THEN 'CLOSED_UNDETERMINED' ELSE 'OPEN' END END"""

ORACLES: dict[str, str] = {
    "lifecycle_state": f"""SELECT market, state, state IN ('VOIDED', 'DETERMINED_YES', 'DETERMINED_NO') AS determined, CAST(CASE WHEN settlement_value IS NULL THEN map {{'DETERMINED_YES': 1.0, 'DETERMINED_NO': 0.0}}[state]
        ELSE CAST(settlement_value AS DOUBLE) / nullif(CAST(coalesce(notional_value, 1) AS DOUBLE), 0) END AS DECIMAL(12,6)) AS payout,
        CASE WHEN settlement_value IS NOT NULL AND coalesce(notional_value, 1) = 0 THEN 'none' WHEN settlement_value IS NOT NULL THEN 'settlement_value' WHEN state LIKE 'DETERMINED%' THEN 'result' ELSE 'none' END AS basis
        FROM (SELECT *, {_STATE} AS state FROM markets) m""",
    "ticker_parts": """SELECT market, parts[1] || '-' || parts[2] AS event, parts[1] AS series, strftime(make_timestamp(ms * 1000), '%H:00') AS hour_utc,
        CASE WHEN mo IS NULL THEN 'unknown' ELSE 'D+' || CAST(date_diff('day', CAST(make_timestamp(ms * 1000) AS DATE), make_date(2024, mo, 1)) + CAST(substr(parts[2], 6, 2) AS INT) - 1 AS VARCHAR) END AS days
        FROM (SELECT f.market, f.ms, string_split(ticker, '-') AS parts FROM (SELECT market, max(ms) AS ms FROM fills GROUP BY market) f JOIN markets m ON m.market = f.market) x
        LEFT JOIN (SELECT unnest(['JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC']) AS mon, unnest(range(1, 13)) AS mo) c ON c.mon = substr(parts[2], 3, 3)""",
    "fixed_buckets": """SELECT spread, depth, imbalance, count(*) AS n FROM (SELECT
        coalesce((SELECT min_by(l, e) FROM (VALUES (0.01, '<=1c'), (0.02, '2c'), (0.03, '3c'), (0.05, '4-5c'), (0.1, '6-10c'), (9, '>10c')) v(e, l) WHERE s <= e), 'unknown') AS spread,
        coalesce((SELECT min_by(l, e) FROM (VALUES (50, '<=50'), (200, '51-200'), (1000, '201-1000'), (1e9, '>1000')) v(e, l) WHERE q <= e), 'unknown') AS depth,
        CASE WHEN i IS NULL THEN 'unknown' ELSE ['[-1.0,-0.6]', '(-0.6,-0.2]', '(-0.2,0.2)', '[0.2,0.6)', '[0.6,1.0]'][1 + CAST(i > -3 AS INT) + CAST(i > -1 AS INT) + CAST(i >= 1 AS INT) + CAST(i >= 3 AS INT)] END AS imbalance
        FROM (SELECT CASE WHEN event_id % 9 <> 0 THEN price - 0.05 END AS s, CASE WHEN event_id % 8 <> 0 THEN size * 5 END AS q, CASE WHEN event_id % 7 <> 0 THEN event_id % 11 - 5 END AS i FROM trades) t) b GROUP BY ALL""",
    "fee_outcome": f"""SELECT order_id, line, f.market, qty, price, ms, reason, CASE WHEN reason = 'known' THEN CAST(CASE WHEN raw <= 0 THEN 0 WHEN up THEN ceil(raw * 100) / 100 ELSE trunc(raw * 10000000000) / 10000000000 END AS DECIMAL(24,6)) END AS fee FROM (
        SELECT *, CASE WHEN NOT stated THEN 'market_state_missing' WHEN ft IS NULL THEN 'fee_type_missing' WHEN since IS NULL THEN 'schedule_entry_missing' WHEN NOT verified THEN 'schedule_entry_unverified' ELSE 'known' END AS reason,
          CASE WHEN l_linestatus = 'O' THEN CAST(maker * CAST(qty AS DECIMAL(14,2)) AS DECIMAL(38,10)) ELSE CAST(CAST(qty AS DECIMAL(10,2)) * CAST(price AS DECIMAL(4,2)) * CAST(1 - price AS DECIMAL(4,2)) * CAST(rate AS DECIMAL(4,4)) * CAST(coalesce(fee_multiplier, 1) AS DECIMAL(4,2)) AS DECIMAL(38,12)) END AS raw
        FROM (SELECT f.*, m.market IS NOT NULL AS stated, m.fee_type AS ft, m.fee_multiplier FROM fills f LEFT JOIN (SELECT * FROM markets WHERE market % 10 <> 9) m ON m.market = f.market) j ASOF LEFT JOIN {_SCHEDULE} ON s.fee_type = j.ft AND j.ms >= s.since) f""",
    "canonical_size": "SELECT event_id, printf('%d.%06d', m // 1000000, m % 1000000) AS canonical FROM (SELECT event_id, CASE event_id % 2 WHEN 0 THEN event_id // 2 ELSE event_id // 2 + (event_id // 2) % 2 END AS m FROM events) e",
    "ladder_mapping": """SELECT event_id, CASE o WHEN 'bid' THEN 'yes' ELSE 'no' END AS book_side, CAST(CASE o WHEN 'bid' THEN price ELSE 1 - price END AS DECIMAL(12,6)) AS book_price, price AS back, CAST(price * 100 AS DECIMAL(12,6)) AS cents, price AS again,
        (o = 'bid') = (0.25 > price) AND price <> 0.25 AS other_better, CASE WHEN event_id % 5 <> 0 THEN greatest(0, CAST((0.47 - price) * 100 AS BIGINT) * CASE o WHEN 'bid' THEN 1 ELSE -1 END) END AS ticks,
        CAST(abs(CASE side WHEN 'yes' THEN 0 ELSE 1 END - price) AS DECIMAL(12,6)) AS yes_price, CASE WHEN (side = 'yes') = (event_id % 2 = 0) THEN 'buy' ELSE 'sell' END AS yes_action,
        CAST(CAST(CASE o WHEN 'bid' THEN price ELSE 1 - price END AS DECIMAL(10,6)) * CAST(abs(delta) AS DECIMAL(16,2)) AS DECIMAL(24,6)) AS premium FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'bid' ELSE 'ask' END AS o FROM deltas) d""",
    "ts_normalise": """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN ms END AS ms, event_id % 4 < 2 OR event_id % 8 = 3 AS blank, CASE event_id % 4 WHEN 0 THEN CAST(CAST(ms AS DECIMAL(24,6)) / 1000 AS DECIMAL(24,6)) WHEN 1 THEN CAST(ms AS DECIMAL(24,6)) END AS as_number FROM ev""",
    "channel_route": "SELECT v.k AS kind, v.c AS channel, count(*) AS n FROM events JOIN (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES " + ", ".join(f"('{k}', '{c}')" for k, c in S.CHANNELS.items()) + f", ('heartbeat', NULL)) w(k, c)) v ON v.i = event_id % {len(S.CHANNELS) + 1} GROUP BY ALL",
    "status_vocabulary": "SELECT market, coalesce((SELECT string_agg(DISTINCT q, ',' ORDER BY q) FROM (VALUES (1, 'unopened'), (2, 'open'), (4, 'closed'), (8, 'settled'), (16, 'settled')) v(b, q) WHERE (market // b) % 2 = 1), '') AS statuses FROM markets",
    "end_reasons": "SELECT CASE WHEN event_id % 17 = 0 THEN 'deploy' ELSE ['restart', 'restart', 'deploy', 'shutdown', 'unknown', 'crash'][event_id % 6 + 1] END AS reason, count(*) AS n FROM events GROUP BY ALL",
    "json_lists": """SELECT event_id, CAST((event_id % 90 + 5) / 100.0 AS DECIMAL(12,6)) AS price, size, true AS no_size, 'n' || event_id % 5 || '|u' || event_id % 3 AS names, event_id % 20 IN (market, market + 1) AS affects FROM ev""",
    "structural_hash": """SELECT market, sha256('{"fee_multiplier":' || coalesce('"' || fee_multiplier || '"', 'null') || ',"fee_type":' || coalesce('"' || fee_type || '"', 'null') || ',"notional_value":' || coalesce('"' || notional_value || '"', 'null')
        || ',"result":' || coalesce('"' || result || '"', 'null') || ',"settlement_value":' || coalesce('"' || settlement_value || '"', 'null') || ',"status":' || coalesce('"' || status || '"', 'null') || ',"ticker":"' || ticker || '"}') AS version FROM markets""",
    "eligibility": """SELECT event_id, NOT EXISTS (SELECT 1 FROM (VALUES (3), (5), (8)) v(m) WHERE m = market) AND event_id % 5 IN (1, 2) AND (event_id % 3 = 0 OR event_id % 400 <= 300) AND (event_id % 4 = 0 OR event_id % 700 <= 600) AS eligible FROM ev""",
    "series_resolution": """WITH s AS (SELECT DISTINCT regexp_extract(ticker, '^[^-]*') AS series, split_part(p_type, ' ', 1) AS category FROM markets),
        c AS (SELECT DISTINCT 'named' AS selector, series FROM s WHERE series IN ('KXHIGH1', 'KXRAIN3') UNION SELECT 'by_category', series FROM s WHERE regexp_matches(series, '^KX(HIGH|RAIN)') AND category IN ('PROMO', 'SMALL') AND series NOT IN ('KXHIGH2', 'KXRAIN0')
          UNION SELECT 'by_prefix', series FROM s WHERE regexp_matches(series, '^KX(HIGH|RAIN)') AND series NOT IN ('KXHIGH2', 'KXRAIN0')) SELECT selector, series, (SELECT count(*) FROM c d WHERE d.selector = c.selector) > 5 AS over_scope FROM c""",
    "latency_samples": "SELECT series, count(*) AS n, min(x) AS least, max(x) AS most, CAST(sum(x) AS BIGINT) AS total FROM (SELECT series, (event_id % 41 - 4) * 20000 AS x FROM ev WHERE event_id % 6 <> 0 AND event_id % 41 BETWEEN 4 AND 34) d GROUP BY series",
    "risk_envelope": f"""WITH m AS (SELECT market, series, sum(CAST(event_type = 'view' AS INT)) AS resting, sum(CAST(event_type = 'error' AND event_id % 37 = 0 AS INT)) AS fl, sum(CAST(event_type = 'purchase' AS INT)) AS fills, count(*) AS orders,
          coalesce(sum(size) FILTER (WHERE event_type = 'signup'), 0) AS pos FROM ev GROUP BY market, series)
        SELECT market, coalesce((SELECT min_by(name, i) FROM (VALUES (1, 'probe_already_in_flight', fl > 0), (2, 'max_resting_orders', (SELECT sum(resting % 4) FROM m) % 401 + (SELECT sum(fl) FROM m) >= {LIMITS['resting']}), (3, 'max_resting_per_market', resting % 14 >= {LIMITS['resting_per_market']}),
          (4, 'max_probes_per_series', (SELECT sum(fl) FROM m n WHERE n.series = m.series) % 20 >= {LIMITS['probes_per_series']}), (5, 'max_position_per_market', pos + {LIMITS['order_size']} > {LIMITS['position']}), (6, 'max_worst_case_exposure', pos * 8 > {LIMITS['exposure']}),
          (7, 'max_fills_per_day', fills >= {LIMITS['fills']}), (8, 'max_new_orders_per_day', orders >= {LIMITS['orders']})) v(i, name, hit) WHERE hit), 'allowed') AS reason,
          coalesce((SELECT min_by(name, i) FROM (VALUES (1, 'private_feed_down', market % 29 = 0), (2, 'ambiguous_order_state', fl > 1), (3, 'risk_limit', pos > {LIMITS['position']} OR pos * 8 > {LIMITS['exposure']})) v(i, name, hit) WHERE hit), 'none') AS blocking FROM m""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        lifecycle_state, ticker_parts, fixed_buckets, fee_outcome, canonical_size, ladder_mapping, ts_normalise, channel_route, status_vocabulary, end_reasons, json_lists, structural_hash, eligibility,
        series_resolution, latency_samples, probe_eligibility, risk_envelope,
    )
    return {f.__name__: f for f in own}
