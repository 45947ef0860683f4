"""Wire frames as typed events: one pass over the text as VARIANT, and a quarantine for what does not fit. No frame is lost.

Every frame is in exactly one of three places: an event with its fields, a frame of a kind that is only kept raw, or the quarantine with the
first reason that applies. Prices and sizes are rounded half to even at six places, as both ends of a comparison must be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.scalar import PRICE, SIZE

#: Kinds of frames that become events, with their type on the wire; sides of a market and of a book.
KINDS = {"orderbook_snapshot": "snapshot", "orderbook_delta": "delta", "trade": "trade"}
SIDES, BOOK_SIDES = ("yes", "no"), ("bid", "ask")
LEVELS = f"array<struct<price: {PRICE}, size: {SIZE}>>"


def _text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def _whole(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "bigint")


def canonical(value: Column, kind: str) -> Column:
    """A decimal text to six places, half to even; null where it is none."""
    return F.bround(F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), value).try_cast("decimal(38,12)"), 6).cast(kind)


def parsed(frames: DataFrame) -> DataFrame:
    """frames (ordinal, receive_ms, text, and any more) with kind, reason, sid, seq, market, exchange_ms and each kind's own fields.

    kind: ``snapshot``, ``delta``, ``trade``; ``raw`` for other types; null for a frame that is quarantined, whose reason says why:
    ``not json``, ``no type``, or ``schema:`` and the first field that is missing or wrong. A side without interest has no levels.
    """
    doc = frames.withColumn("_v", F.try_parse_json("text"))
    v, wire = F.col("_v"), _text(F.col("_v"), "$.type")
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    base = doc.select(
        *frames.columns, v.alias("_v"), wire.alias("type"), known[wire].alias("_kind"), _whole(v, "$.sid").alias("sid"), _whole(v, "$.seq").alias("seq"), _text(v, "$.msg.market_ticker").alias("market"),
        _whole(v, "$.msg.ts_ms").alias("exchange_ms"), _text(v, "$.msg.side").alias("side"), canonical(_text(v, "$.msg.price_dollars"), PRICE).alias("price"), canonical(_text(v, "$.msg.delta_fp"), SIZE).alias("delta"),
        _text(v, "$.msg.trade_id").alias("trade_id"), canonical(_text(v, "$.msg.yes_price_dollars"), PRICE).alias("yes_price"), canonical(_text(v, "$.msg.no_price_dollars"), PRICE).alias("no_price"),
        canonical(_text(v, "$.msg.count_fp"), SIZE).alias("count"), F.coalesce(_text(v, "$.msg.taker_outcome_side"), _text(v, "$.msg.taker_side")).alias("taker_side"), _text(v, "$.msg.taker_book_side").alias("taker_book_side"),
        F.coalesce(F.try_variant_get(v, "$.msg.is_block_trade", "boolean"), F.lit(False)).alias("is_block"),
        *[_ladder(v, f"$.msg.{side}_dollars_fp").alias(f"{side}_levels") for side in SIDES],
        *[(F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.msg.{side}_dollars_fp", "variant")), F.lit("VOID")) == "VOID").alias(f"_no_{side}") for side in SIDES],
    )
    odd = lambda c, among: F.col(c).isNotNull() & ~F.col(c).isin(*among)
    wrong_levels = lambda side: ~F.col(f"_no_{side}") & (F.col(f"{side}_levels").isNull() | F.exists(F.coalesce(f"{side}_levels", F.array().cast(LEVELS)), lambda x: x["price"].isNull() | x["size"].isNull()))
    need = {
        "snapshot": [("yes_dollars_fp", wrong_levels("yes")), ("no_dollars_fp", wrong_levels("no"))],
        "delta": [("price_dollars", F.col("price").isNull()), ("delta_fp", F.col("delta").isNull()), ("side", F.col("side").isNull() | odd("side", SIDES))],
        "trade": [
            ("trade_id", F.col("trade_id").isNull()), ("yes_price_dollars", F.col("yes_price").isNull()), ("no_price_dollars", F.col("no_price").isNull()), ("count_fp", F.col("count").isNull()),
            ("taker_outcome_side", odd("taker_side", SIDES)), ("taker_book_side", odd("taker_book_side", BOOK_SIDES)),
        ],
    }
    reason = F.when(v.isNull(), "not json").when(F.col("type").isNull(), "no type").when(F.col("_kind").isNotNull() & F.col("market").isNull(), "schema: market_ticker")
    for kind, checks in need.items():
        for name, fails in checks:
            reason = reason.when((F.col("_kind") == kind) & F.coalesce(fails, F.lit(True)), f"schema: {name}")
    judged = base.withColumn("reason", reason)
    kind = F.when(F.col("reason").isNull(), F.coalesce("_kind", F.lit("raw")))
    own = {"side": "delta", "price": "delta", "delta": "delta", "trade_id": "trade", "yes_price": "trade", "no_price": "trade", "count": "trade", "taker_side": "trade", "taker_book_side": "trade", "is_block": "trade", "yes_levels": "snapshot", "no_levels": "snapshot"}
    fields = [F.when(F.col("kind") == k, F.coalesce(c, F.array().cast(LEVELS)) if c.endswith("_levels") else F.col(c)).alias(c) for c, k in own.items()]
    return judged.withColumn("kind", kind).select(*frames.columns, "kind", "reason", "type", "sid", "seq", "market", "exchange_ms", *fields)


def _ladder(doc: Column, path: str) -> Column:
    pairs = F.try_variant_get(doc, path, "array<array<string>>")
    return F.transform(pairs, lambda p: F.struct(canonical(F.get(p, F.lit(0)), PRICE).alias("price"), canonical(F.get(p, F.lit(1)), SIZE).alias("size")))


def split(frames: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(snapshot levels, deltas, trades, quarantine) of parsed frames; what is raw is in none of them.

    Snapshots are rows of levels, one with neither side nor price for an empty book.
    """
    snapshots = frames.where("kind = 'snapshot'")
    level = lambda side: F.transform(f"{side}_levels", lambda x: F.struct(F.lit(side).alias("side"), x["price"].alias("price"), x["size"].alias("size")))
    levels = snapshots.select("ordinal", "receive_ms", "sid", "seq", "market", F.explode_outer(F.concat(level("yes"), level("no"))).alias("l")).select("ordinal", "receive_ms", "sid", "seq", "market", "l.*")
    deltas = frames.where("kind = 'delta'").select("ordinal", "receive_ms", "sid", "seq", "market", "exchange_ms", "side", "price", "delta")
    trades = frames.where("kind = 'trade'").select("ordinal", "receive_ms", "sid", "seq", "market", "exchange_ms", "trade_id", "yes_price", "no_price", "count", "taker_side", "taker_book_side", "is_block")
    return levels, deltas, trades, frames.where("reason IS NOT NULL").select("ordinal", "receive_ms", "reason", "text")


def gated(frames: DataFrame) -> DataFrame:
    """parsed frames with a ``verdict`` of their sequence, and whether they may change a book: ``applies`` and, where not, ``skip_reason``.

    A gap, a repeated or a late number changes nothing; while a stream is degraded only a snapshot does.
    """
    v, snapshot = F.col("verdict"), F.col("kind") == "snapshot"
    reason = (
        F.when(v.isin("gap", "duplicate", "out_of_order"), F.concat(F.lit("sequence "), v))
        .when((v == "degraded") & ~F.coalesce(snapshot, F.lit(False)), "stream degraded; awaiting recovery snapshot")
        .when(F.col("reason").isNotNull(), "quarantined")
    )
    return frames.withColumn("skip_reason", reason).withColumn("applies", F.col("skip_reason").isNull() & F.col("kind").isin("snapshot", "delta", "trade"))
