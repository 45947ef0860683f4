"""Scalar functions of the market domain as column expressions: nothing leaves whole-stage code.

Prices are DECIMAL(12,6) in [0, 1], sizes DECIMAL(24,6); a null argument gives a null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE, SIZE = "decimal(12,6)", "decimal(24,6)"
#: Message types and their channels.
CHANNELS = {
    "orderbook_snapshot": "orderbook_delta", "orderbook_delta": "orderbook_delta", "trade": "trade", "ticker": "ticker", "ticker_v2": "ticker", "fill": "fill",
    "market_lifecycle_v2": "market_lifecycle_v2", "event_lifecycle": "market_lifecycle_v2", "event_fee_update": "market_lifecycle_v2",
    "market_position": "market_positions", "user_order": "user_orders",
}
#: A market's status and the status by which the exchange is asked for it.
QUERY_STATUS = {"initialized": "unopened", "active": "open", "inactive": "closed", "closed": "closed", "determined": "settled", "finalized": "settled"}
#: Upper edges of the buckets of spreads (cents), depths and imbalances.
SPREADS = ((1, "<=1c"), (2, "2c"), (3, "3c"), (5, "4-5c"), (10, "6-10c"))
DEPTHS = ((50, "<=50"), (200, "51-200"), (1000, "201-1000"))
MONTHS = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


# ---- prices


def canonical(c: Column, kind: str = PRICE) -> Column:
    """The number as text with six places, halves to even."""
    return F.bround(c, 6).cast(kind).cast("string")


def cents_to_price(c: Column) -> Column:
    return (c.cast("decimal(14,2)") / 100).cast(PRICE)


def price_to_cents(c: Column) -> Column:
    return (c * 100).cast(PRICE)


def complement(c: Column) -> Column:
    return (F.lit(1) - c).cast(PRICE)


def public_level(side: Column, yes_price: Column) -> tuple[Column, Column]:
    """(book side, price) at which an order on the yes scale rests: asks are the no ladder's complements."""
    bid = side == "bid"
    return F.when(bid, F.lit("yes")).otherwise("no"), F.when(bid, yes_price).otherwise(complement(yes_price))


def yes_price_of(book_side: Column, price: Column) -> Column:
    return F.when(book_side == "yes", price).otherwise(complement(price))


def is_better(side: Column, ours: Column, other: Column) -> Column:
    """Whether ``other`` stands before ``ours`` on that side, both on the yes scale."""
    return F.when(side == "bid", other > ours).otherwise(other < ours)


def ticks_from_touch(side: Column, ours: Column, bid: Column, ask: Column) -> Column:
    """Cents behind the best price, 0 where it is reached or passed, null without one."""
    away = F.when(side == "bid", bid - ours).otherwise(ours - ask)
    return F.when(away.isNotNull(), F.greatest(F.lit(0), F.floor(away * 100 + F.lit("0.5").cast("decimal(2,1)"))).cast("long"))


def yes_equivalent(side: Column, action: Column, price: Column) -> tuple[Column, Column]:
    """(yes price, yes action) of an order on either side: selling no is buying yes."""
    flipped = F.when(action == "buy", F.lit("sell")).otherwise("buy")
    return F.when(side == "yes", price).otherwise(complement(price)), F.when(side == "yes", action).otherwise(flipped)


def premium(side: Column, yes_price: Column, contracts: Column) -> Column:
    """Dollars lost at worst if an order on the yes scale is filled."""
    return (F.when(side == "bid", yes_price).otherwise(complement(yes_price)).cast("decimal(10,6)") * contracts.cast("decimal(16,2)")).cast(SIZE)


# ---- markets


def lifecycle_state(status: Column, result: Column) -> Column:
    """One of five states; the result speaks before the status, blanks and case do not count."""
    r, s = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (result, status))
    return (
        F.when(r == "yes", "DETERMINED_YES").when(r == "no", "DETERMINED_NO").when(r.isin("void", "voided", "cancelled", "canceled"), "VOIDED")
        .when(s.isin("closed", "determined", "settled", "finalized"), "CLOSED_UNDETERMINED").otherwise("OPEN")
    )


def is_determined(state: Column) -> Column:
    return state.isin("DETERMINED_YES", "DETERMINED_NO", "VOIDED")


def yes_payout(state: Column, settlement: Column, notional: Column) -> tuple[Column, Column]:
    """(payout of a yes contract, what it is based on); no payout where the notional value is zero or nothing is known."""
    whole = F.coalesce(notional, F.lit(1).cast(PRICE))
    known = settlement.isNotNull()
    value = F.when(known & (whole != 0), F.try_divide(settlement, whole)).when(~known & (state == "DETERMINED_YES"), F.lit(1)).when(~known & (state == "DETERMINED_NO"), F.lit(0))
    basis = F.when(known & (whole != 0), "settlement_value").when(~known & state.isin("DETERMINED_YES", "DETERMINED_NO"), "result").otherwise("none")
    return value.cast(PRICE), basis


def event_of(ticker: Column) -> Column:
    return F.substring_index(ticker, "-", 2)


def series_of(ticker: Column) -> Column:
    return F.substring_index(ticker, "-", 1)


def days_to_event(ticker: Column, at_ms: Column) -> Column:
    """``D+n`` from the instant's UTC day to the date in the ticker; ``unknown`` without a date, or with no such month."""
    part = lambda k: F.regexp_extract(ticker, r"-(\d{2})([A-Z]{3})(\d{2})-", k)
    place = F.instr(F.lit(MONTHS), part(2))
    known = (part(2) != "") & (place % 3 == 1)
    # days past the end of a month run into the next one
    first = F.try_to_timestamp(F.concat(F.lit("20"), part(1), F.lit("-"), F.lpad(((place + 2) / 3).cast("int").cast("string"), 2, "0"), F.lit("-01"))).cast("date")
    days = F.datediff(first, F.timestamp_millis(at_ms).cast("date")) + part(3).try_cast("int") - 1
    return F.when(known, F.concat(F.lit("D+"), days.cast("string"))).otherwise("unknown")


def hour_utc(ms: Column) -> Column:
    return F.concat(F.lpad((F.floor(ms / 3_600_000) % 24).cast("string"), 2, "0"), F.lit(":00"))


def _bucket(c: Column, edges, above: str) -> Column:
    out = F.when(c.isNull(), "unknown")
    for edge, label in edges:
        out = out.when(c <= edge, label)
    return out.otherwise(above)


def spread_bucket(spread: Column) -> Column:
    return _bucket(spread * 100, SPREADS, ">10c")


def depth_bucket(depth: Column) -> Column:
    return _bucket(depth, DEPTHS, ">1000")


def imbalance_bucket(v: Column) -> Column:
    return (
        F.when(v.isNull(), "unknown").when(v <= -0.6, "[-1.0,-0.6]").when(v <= -0.2, "(-0.6,-0.2]").when(v < 0.2, "(-0.2,0.2)").when(v < 0.6, "[0.2,0.6)").otherwise("[0.6,1.0]")
    )


def stratum(touch_depth: Column, recent_trades: Column) -> Column:
    return F.concat_ws("/", F.when(touch_depth >= 100, "high_depth").otherwise("low_depth"), F.when(recent_trades >= 3, "high_flow").otherwise("low_flow"))


def fee(liquidity: Column, base_rate: Column, multiplier: Column, maker_fee: Column, round_up: Column, qty: Column, price: Column) -> Column:
    """Dollars: takers pay rate x multiplier x q x p x (1 - p), makers an amount a contract; nothing below zero."""
    q, p = qty.cast("decimal(14,2)"), price.cast("decimal(6,4)")
    rest = (F.lit(1) - p).cast("decimal(6,4)")
    taker = (q * p).cast("decimal(20,6)") * rest * (base_rate.cast("decimal(4,4)") * F.coalesce(multiplier, F.lit(1)).cast("decimal(4,2)")).cast("decimal(7,6)")
    raw = F.when(liquidity == "taker", taker.cast("decimal(38,16)")).otherwise((maker_fee.cast("decimal(6,4)") * q).cast("decimal(38,16)"))
    cents = (F.ceil(raw * 100).cast("decimal(22,0)") / 100).cast(SIZE)
    return F.when(raw <= 0, F.lit(0).cast(SIZE)).when(round_up, cents).otherwise(raw.cast(SIZE))


def market_eligible(market: Column, status: Column, now: Column, open_ms: Column, close_ms: Column, allow=(), deny=(), statuses=(), lead_ms: int | None = None, retain_ms: int | None = None) -> Column:
    """Whether a selector takes a market: lists first, then the status, then the time before opening and after closing."""
    out = ~market.isin(*deny) if deny else F.lit(True)
    if allow:
        out = out & market.isin(*allow)
    if statuses:
        out = out & F.coalesce(status.isin(*statuses), F.lit(False))
    if lead_ms is not None:
        out = out & F.coalesce(now >= open_ms - lead_ms, F.lit(True))
    if retain_ms is not None:
        out = out & F.coalesce(now <= close_ms + retain_ms, F.lit(True))
    return out


def first_reason(*cascade: tuple[str, Column], otherwise: str) -> Column:
    """The name of the first condition that holds; an unknown condition does not."""
    out = F
    for name, condition in cascade:
        out = out.when(F.coalesce(condition, F.lit(False)), F.lit(name))
    return out.otherwise(otherwise)


def probe_reason(has_book, valid, state, bid, ask, bid_size, close_in_ms, recent_deltas, min_mid: float, max_mid: float, min_ms_to_close: int) -> Column:
    """Why a market is not probed, the first of eight reasons, or ``eligible``."""
    mid = (bid + ask) / 2
    return first_reason(
        ("no_book", ~has_book), ("book_invalid", ~valid), ("not_active", state != "OPEN"), ("not_two_sided", bid.isNull() | ask.isNull()), ("no_touch_size", bid_size.isNull() | (bid_size <= 0)),
        ("mid_out_of_band", (mid < min_mid) | (mid > max_mid)), ("too_close_to_close", close_in_ms < min_ms_to_close), ("no_recent_activity", recent_deltas < 5), otherwise="eligible",
    )


def risk_reason(in_flight, resting, all_resting, all_in_flight, series_in_flight, position, exposure, fills, orders, limits: dict[str, int]) -> Column:
    """Why an account may place no further probe in a market, the first of eight reasons, or ``allowed``; an order in flight counts as a resting one."""
    return first_reason(
        ("probe_already_in_flight", in_flight > 0), ("max_resting_orders", all_resting + all_in_flight >= limits["resting"]), ("max_resting_per_market", resting >= limits["resting_per_market"]),
        ("max_probes_per_series", series_in_flight >= limits["probes_per_series"]), ("max_position_per_market", F.abs(position) + limits["order_size"] > limits["position"]),
        ("max_worst_case_exposure", exposure > limits["exposure"]), ("max_fills_per_day", fills >= limits["fills"]), ("max_new_orders_per_day", orders >= limits["orders"]), otherwise="allowed",
    )


def resolution(qty: Column, has_state: Column, state: Column, payout: Column, marked: Column) -> Column:
    """What becomes of a position at the end of a run; flat ones have none."""
    left = F.when(marked, F.when(has_state & (state == "CLOSED_UNDETERMINED"), "AWAITING_DETERMINATION").otherwise("OPEN_AT_RUN_END")).otherwise("UNPRICEABLE")
    return F.when(qty == 0, F.lit(None).cast("string")).when(has_state & (state == "VOIDED"), "VOIDED").when(has_state & payout.isNotNull(), "SETTLED").otherwise(left)


# ---- messages and text


def channel_for(kind: Column) -> Column:
    return _mapped(kind, CHANNELS)


def query_statuses(statuses: Column) -> Column:
    """The exchange's words for a list of statuses, each once, unknown ones left out."""
    return F.array_distinct(F.filter(F.transform(statuses, lambda s: _mapped(s, QUERY_STATUS)), lambda s: s.isNotNull()))


def epoch_ms(number: Column, text: Column) -> Column:
    """Milliseconds of a number in seconds (under 1e11) or milliseconds, else of an ISO text; blanks and other texts are null."""
    by_number = F.round(F.when(number < 1e11, number * 1000).otherwise(number)).cast("long")
    return F.coalesce(by_number, F.unix_millis(F.try_to_timestamp(F.when(F.trim(text) != "", text))))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def numeric_text(c: Column, kind: str = SIZE) -> Column:
    """A text as a decimal; null where it is no number."""
    return F.trim(c).try_cast(kind)


def reason_for_end(end: Column, deploying: Column) -> Column:
    return (
        F.when(deploying, "deploy").when(end.isNull(), "crash").when(end.isin("sigterm", "sigint"), "restart").when(F.startswith(end, F.lit("deploy")), "deploy")
        .when(F.contains(end, F.lit("shutdown")), "shutdown").otherwise("unknown")
    )


def price_levels(text: Column) -> Column:
    """``[[price, size], ...]`` as JSON, numbers as text, to an array of (price, size)."""
    pairs = F.from_json(text, "array<array<string>>")
    return F.transform(pairs, lambda x: F.struct(x[0].try_cast(PRICE).alias("price"), x[1].try_cast(SIZE).alias("size")))


def source_names(text: Column) -> Column:
    """Names of a JSON list of sources: the name, else the url; blanks are dropped."""
    listed = F.from_json(text, "array<struct<name:string,url:string>>")
    return F.filter(F.transform(listed, lambda s: F.coalesce(s["name"], s["url"])), lambda n: F.trim(n) != "")


def json_holds(text: Column, item: Column) -> Column:
    """Whether a JSON list of texts holds ``item``."""
    return F.array_contains(F.from_json(text, "array<string>"), item)


def structural_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON with sorted names, null fields spelled as null."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(quoted(fields[k]), F.lit("null"))) for k in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def series_chosen(series: Column, category: Column, prefixes: tuple[str, ...] = (), categories: tuple[str, ...] = (), allow: tuple[str, ...] = (), deny: tuple[str, ...] = ()) -> Column:
    """Whether a selector takes a series: by name from its allow-list where it has one, else by prefix and, if it names any, category; denied ones never."""
    by_prefix = F.lit(False)
    for p in prefixes:
        by_prefix = by_prefix | F.startswith(series, F.lit(p))
    wanted = series.isin(*allow) if allow else by_prefix & (category.isin(*categories) if categories else F.lit(True))
    return F.coalesce(wanted & ~series.isin(*deny) if deny else wanted, F.lit(False))


def latency_kept(received_ms: Column, exchange_ms: Column) -> Column:
    """The delay of a message where it counts as a sample: 0 to 600,000 ms, and the exchange's time is known."""
    delay = received_ms - exchange_ms
    return F.when(delay.between(0, 600_000), delay)
