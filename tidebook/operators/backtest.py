"""Backtest of quoting strategies: an event loop in which a strategy reacts to the book and to its own fills.

A market shares nothing with another but the account, whose limits are per market here, so a market is the unit of
work: tasks read their markets' events in order, once, with one book in hand that every scenario of strategy, fill model and
latency looks at, as no order of theirs changes it. Inventory carries over resets, so a market can't be cut: the largest one
bounds the longest task. Prices and sizes are exact integers of a millionth.

Order within an instant, against the strategy: actions due before it take effect first, cancels before activations; then
the event; then actions due at that very instant; then the strategy sees the outcome.
"""

from __future__ import annotations

import heapq
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ONE = 1_000_000
ROWS = (
    "strategy string, model string, latency_ms long, market long, order_id long, step long, ms long, state string, side string, price long, "
    "qty long, liquidity string, queue_ahead long, position long"
)


class Strategy(Protocol):
    """Gives the quotes it wants, as (bid, ask) yes prices; None leaves a side empty.

    One whose quotes depend on these arguments alone may say ``stateless = True``: it is not asked again while they stay the same.
    """

    def quotes(self, bid: int, ask: int, bid_size: int, ask_size: int, position: int) -> tuple[int | None, int | None]: ...


class JoinBest:
    """Both best prices."""

    stateless = True

    def quotes(self, bid, ask, bid_size, ask_size, position):
        return bid, ask


class ImbalanceMaker:
    """The best prices, but not on the side that the sizes lean against; ``policy``: skip, step_back or flat."""

    stateless = True

    def __init__(self, threshold: float = 0.3, policy: str = "skip", tick: int = 10_000):
        if policy not in ("skip", "step_back", "flat"):
            raise ValueError(f"unknown policy {policy}")
        self.threshold, self.policy, self.tick = threshold, policy, tick

    def quotes(self, bid, ask, bid_size, ask_size, position):
        lean = (bid_size - ask_size) / (bid_size + ask_size)
        if abs(lean) < self.threshold:
            return bid, ask
        if self.policy == "flat":
            return None, None
        if self.policy == "step_back":
            return (bid - self.tick, ask) if lean < 0 else (bid, ask + self.tick)
        return (None, ask) if lean < 0 else (bid, None)


class InventorySkew:
    """The best prices moved by a tick against every ``step`` contracts held."""

    stateless = True

    def __init__(self, step: int = 10 * ONE, tick: int = 10_000):
        self.step, self.tick = step, tick

    def quotes(self, bid, ask, bid_size, ask_size, position):
        shift = -(position // self.step if position >= 0 else -(-position // self.step)) * self.tick
        return min(bid + shift, bid), max(ask + shift, ask)


#: Strategies by name; a user's own class joins them here.
STRATEGIES: dict[str, type] = {"join_best": JoinBest, "imbalance": ImbalanceMaker, "inventory_skew": InventorySkew}


class FillModel(Protocol):
    """How much of a print passes the queue before an order, and what a decrease of its level does to that queue."""

    def anchor(self, size: int) -> int: ...

    def decrease(self, ahead: int, gone: int) -> int: ...


class Touch:
    """No queue: a print at the price fills."""

    def anchor(self, size):
        return 0

    def decrease(self, ahead, gone):
        return ahead


class Conservative(Touch):
    """All that stood there before must trade first."""

    def anchor(self, size):
        return size


class Decay(Conservative):
    """A share of what others cancel is taken from the queue ahead."""

    def __init__(self, credit: float = 0.5):
        self.credit = credit

    def decrease(self, ahead, gone):
        return max(0, ahead - int(gone * self.credit))


MODELS: dict[str, type] = {"touch": Touch, "conservative": Conservative, "decay": Decay}


class Book:
    """One market's levels and, of a valid two-sided book, ``top``: (bid, ask, bid size, ask size)."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.levels: dict[str, dict[int, int]] = {"yes": {}, "no": {}}
        self.best: dict[str, int | None] = {"yes": None, "no": None}
        self.valid, self.top = True, None

    def delta(self, side: str, price: int, change: int) -> bool:
        """Whether the change was applied: one that makes a level negative invalidates the book until the next reset."""
        if not self.valid:
            return False
        levels, best = self.levels[side], self.best[side]
        after = levels.get(price, 0) + change
        if after < 0:
            self.valid, self.top = False, None
            return False
        if after:
            levels[price] = after
        else:
            levels.pop(price, None)
        if best is None or price >= best:
            self.best[side] = price if after else max(levels, default=None)
            yes, no = self.best["yes"], self.best["no"]
            self.top = None if yes is None or no is None else (yes, ONE - no, self.levels["yes"][yes], self.levels["no"][no])
        return True


class Exchange:
    """One market's orders and position in one scenario, over a book that scenarios may share."""

    def __init__(self, strategy: Strategy, model: FillModel, latency: int, cancel_latency: int, on_gap: str, size: int, cap: int, min_spread: int, reprice: int, book: Book | None = None):
        if on_gap not in ("cancel_all", "keep_resting", "freeze"):
            raise ValueError(f"unknown gap policy {on_gap}")
        self.strategy, self.model, self.latency, self.cancel_latency, self.on_gap = strategy, model, latency, cancel_latency, on_gap
        self.size, self.cap, self.min_spread, self.reprice = size, cap, min_spread, reprice
        self.book = book or Book()
        self.frozen, self.position, self.next_id, self.turn, self.told = False, 0, 1, 0, 0
        self.pending: list[tuple] = []
        self.resting: dict[int, dict] = {}
        self.quoted: dict[str, tuple[int, int]] = {}  # side -> (order, price) that stands or is on its way
        self.out: list[tuple] = []
        self.now = -1
        # with a reprice step of nought a standing quote is moved each time
        self.settles, self.answered = getattr(strategy, "stateless", False) and reprice > 0, None

    # ---- what is told

    def tell(self, order: int, ms: int, state: str, side: str, price: int, qty: int, liquidity: str | None = None, ahead: int | None = None) -> None:
        self.out.append((order, self.told, ms, state, side, price, qty, liquidity, ahead, self.position))
        self.told += 1

    def taken(self) -> list[tuple]:
        """What was told since the last time."""
        rows, self.out = self.out, []
        return rows

    # ---- intents

    def submit(self, ms: int, side: str, price: int, qty: int, ioc: bool = False) -> int:
        order, self.next_id, self.turn = self.next_id, self.next_id + 1, self.turn + 1
        if qty <= 0 or not 0 < price < ONE:
            self.tell(order, ms, "rejected", side, price, qty)
            return order
        self.tell(order, ms, "submitted", side, price, qty)
        heapq.heappush(self.pending, (ms + self.latency, 1, self.turn, "activate", order, side, price, qty, ioc))
        return order

    def cancel(self, ms: int, order: int) -> None:
        self.turn += 1
        heapq.heappush(self.pending, (ms + self.cancel_latency, 0, self.turn, "cancel", order, None, 0, 0, False))

    # ---- time

    def advance(self, ms: int) -> None:
        """Actions due up to ``ms`` take effect, cancels before activations of the same instant."""
        while self.pending and self.pending[0][0] <= ms:
            at, _, _, kind, order, side, price, qty, ioc = heapq.heappop(self.pending)
            if kind == "cancel":
                if o := self.resting.pop(order, None):
                    self.tell(order, at, "cancelled", o["side"], o["price"], o["left"])
                else:  # it may still be on its way
                    due = [p for p in self.pending if p[3] == "activate" and p[4] == order]
                    for p in due:
                        self.pending.remove(p)
                        self.tell(order, at, "cancelled", p[5], p[6], p[7])
                    if due:
                        heapq.heapify(self.pending)
            else:
                self.activate(at, order, side, price, qty, ioc)

    def activate(self, ms: int, order: int, side: str, price: int, qty: int, ioc: bool) -> None:
        if not self.book.valid or self.frozen:
            self.tell(order, ms, "rejected", side, price, qty)
            self.forget(order)
            return
        against = "no" if side == "bid" else "yes"
        other, first = self.book.levels[against], self.book.best[against]
        crosses = first is not None and (ONE - first <= price if side == "bid" else first >= price)
        for level in sorted(other, reverse=True) if crosses else ():  # the best of the other side first
            at = ONE - level if side == "bid" else level
            if qty <= 0 or (at > price if side == "bid" else at < price):
                break
            got = min(qty, other[level])
            qty -= got
            self.fill(order, ms, side, at, got, "taker", None)
        if qty and ioc:
            self.tell(order, ms, "cancelled", side, price, qty)
        elif qty:
            own, level = ("yes", price) if side == "bid" else ("no", ONE - price)
            ahead = self.model.anchor(self.book.levels[own].get(level, 0))
            self.resting[order] = {"side": side, "price": price, "left": qty, "ahead": ahead, "born": (ms, order)}
            self.tell(order, ms, "resting", side, price, qty, None, ahead)
        if not qty or ioc:
            self.forget(order)

    def forget(self, order: int) -> None:
        self.quoted, self.answered = {s: q for s, q in self.quoted.items() if q[0] != order}, None

    def fill(self, order: int, ms: int, side: str, price: int, qty: int, liquidity: str, ahead: int | None) -> None:
        self.position += qty if side == "bid" else -qty
        self.tell(order, ms, "filled", side, price, qty, liquidity, ahead)

    # ---- events

    def decreased(self, side: str, price: int, gone: int) -> None:
        """Others have drawn ``gone`` from a level of the book."""
        ours = ("bid", price) if side == "yes" else ("ask", ONE - price)
        for o in self.resting.values():
            if (o["side"], o["price"]) == ours:
                o["ahead"] = self.model.decrease(o["ahead"], gone)

    def trade(self, ms: int, taker: str, price: int, size: int) -> None:
        """A print reaches resting orders of the other side at its price or better, best first, then first come; they share it."""
        if self.frozen:
            return
        side, sign = ("bid", -1) if taker == "no" else ("ask", 1)
        reached = [i for i, o in self.resting.items() if o["side"] == side and sign * o["price"] <= sign * price]
        for order in sorted(reached, key=lambda i: (sign * self.resting[i]["price"], self.resting[i]["born"])):
            if size <= 0:
                return
            o = self.resting[order]
            ahead = o["ahead"]
            if o["price"] == price:
                used = min(ahead, size)
                o["ahead"] -= used
                size -= used
            got = min(o["left"], size)
            if got:
                o["left"] -= got
                size -= got
                self.fill(order, ms, side, o["price"], got, "maker", ahead)
                if not o["left"]:
                    del self.resting[order]
                    self.forget(order)

    def gap(self, ms: int) -> None:
        """A reset: resting orders follow the policy."""
        if self.on_gap == "freeze":
            self.frozen = True
        elif self.on_gap == "cancel_all":
            for order in sorted(self.resting):
                o = self.resting.pop(order)
                self.tell(order, ms, "cancelled_by_gap", o["side"], o["price"], o["left"])
                self.forget(order)

    def react(self, ms: int) -> None:
        """Quotes are moved where the wanted price is a reprice step away, and drawn where the inventory is full."""
        top = self.book.top
        if top is None or self.frozen or (self.settles and self.answered == (top, self.position)):
            return
        wanted = self.strategy.quotes(*top, self.position) if top[1] - top[0] >= self.min_spread else (None, None)
        for side, price in zip(("bid", "ask"), wanted, strict=True):
            if (self.position if side == "bid" else -self.position) + self.size > self.cap:
                price = None
            have = self.quoted.get(side)
            if have and (price is None or abs(have[1] - price) >= self.reprice):
                self.cancel(ms, have[0])
                del self.quoted[side]
                have = None
            if price is not None and not have:
                self.quoted[side] = (self.submit(ms, side, price, self.size), price)
        self.answered = (top, self.position)

    def step(self, ms: int, kind: str, side: str | None, price: int, size: int) -> None:
        if ms < self.now:
            raise ValueError(f"time runs back from {self.now} to {ms}")
        self.now = ms
        step([self], self.book, ms, kind, side, price, size)


def step(exchanges: list[Exchange], book: Book, ms: int, kind: str, side: str | None, price: int, size: int) -> None:
    """One event: the book takes it once, then each exchange."""
    for x in exchanges:
        if x.pending and x.pending[0][0] < ms:
            x.advance(ms - 1)
    drawn = False
    if kind == "delta":
        drawn = book.delta(side, price, size) and size < 0
    elif kind != "trade":
        book.clear()
    for x in exchanges:
        if kind == "delta":
            if drawn and x.resting:
                x.decreased(side, price, -size)
        elif kind == "trade":
            if x.resting:
                x.trade(ms, side, price, size)
        else:
            x.gap(ms)
        if x.pending and x.pending[0][0] <= ms:
            x.advance(ms)
        x.react(ms)


def run(
    events: DataFrame, strategies: tuple[str, ...] = ("join_best",), models: tuple[str, ...] = ("conservative",), latencies: tuple[int, ...] = (100,), cancel_ms: int = 100,
    on_gap: str = "cancel_all", size: int = 10, cap: int = 50, min_spread: float = 0.01, reprice: float = 0.01,
) -> DataFrame:
    """Order states of every scenario over events (market, seq, ms, kind, side, price, size), kind ``delta``, ``trade`` or ``gap``.

    A trade's side is its taker's; prices of deltas lie on their own ladder, of trades on the yes scale. Fills carry the
    position after them; sizes are contracts, prices dollars, both exact.
    """
    made, chosen = {k: STRATEGIES[k] for k in strategies}, {m: MODELS[m] for m in models}

    def simulate(batches):
        import pyarrow as pa

        kinds = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64()}[c.split()[1]]) for c in ROWS.split(", ")])
        key, last, book, labels, exchanges = (), None, None, [], []

        def told(found):
            for label, x in zip(labels, exchanges, strict=True):
                found += [(*label, key, *r) for r in x.taken()]

        def ended(found):
            for x in exchanges:
                x.advance(last)
            told(found)

        def table(found):
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

        for batch in batches:
            found = []
            for market, ms, kind, side, price, change in zip(*[batch.column(c).to_pylist() for c in ("market", "ms", "kind", "side", "p", "s")], strict=True):
                if market != key:
                    ended(found)
                    key, book = market, Book()
                    labels = [(name, model, latency) for name in made for model in chosen for latency in latencies]
                    exchanges = [Exchange(made[n](), chosen[m](), latency, cancel_ms, on_gap, size * ONE, cap * ONE, round(min_spread * ONE), round(reprice * ONE), book) for n, m, latency in labels]
                last = ms
                step(exchanges, book, ms, kind, side, price, change)
            told(found)
            yield table(found)
        found = []
        ended(found)
        yield table(found)

    micros = lambda c: F.coalesce((F.col(c) * ONE).cast("long"), F.lit(0))
    packed = events.select("market", "seq", "ms", "kind", "side", micros("price").alias("p"), micros("size").alias("s"))
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = packed.repartition(tasks, "market").sortWithinPartitions("market", "ms", "seq").mapInArrow(simulate, ROWS)
    back = lambda c, kind: (F.col(c).cast("decimal(24,0)") / F.lit(ONE).cast("decimal(8,0)")).cast(kind).alias(c)
    keep = ["strategy", "model", "latency_ms", "market", "order_id", "step", "ms", "state", "side"]
    return out.select(*keep, back("price", "decimal(12,6)"), back("qty", "decimal(24,6)"), "liquidity", back("queue_ahead", "decimal(24,6)"), back("position", "decimal(24,6)"))


def summary(states: DataFrame) -> DataFrame:
    """Of every scenario: orders, fills, contracts, cash and the largest inventory."""
    filled = F.col("state") == "filled"
    signed = F.when(F.col("side") == "bid", -F.col("qty")).otherwise(F.col("qty")).cast("decimal(20,6)") * F.col("price").cast("decimal(8,6)")
    return states.groupBy("strategy", "model", "latency_ms").agg(
        F.count_if(F.col("state") == "submitted").alias("orders"), F.count_if(filled).alias("fills"), F.count_if(filled & (F.col("liquidity") == "taker")).alias("taker_fills"), F.count_if(F.col("state") == "rejected").alias("rejected"),
        F.sum(F.when(filled, F.col("qty"))).cast("decimal(28,6)").alias("contracts"), F.sum(F.when(filled, signed)).cast("decimal(28,6)").alias("cash"), F.max(F.when(filled, F.abs("position"))).alias("largest_position"),
    )
