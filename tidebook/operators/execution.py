"""Simulated execution: orders against trades, one market per group, deterministic and free of look-ahead.

What cannot be a window plan - several orders of one market that share a print in price-time order, cancels in
flight - is a fold over sorted partitions or, for lifecycles, an Arrow grouped map. Markets share nothing, so groups are
exact; sequence numbers, not partitions, break ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILLS = "market long, order_id long, trade_id long, ms long, price double, qty double, model string, latency_ms long"
STATES = "market long, order_id long, seq int, ms long, state string, qty double, price double"


def _by_market(df: DataFrame):
    """Groups by market over all shuffle partitions: their cost is Python's, which merging by bytes would put in few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "market").groupBy("market")


def simulate(
    orders: DataFrame, trades: DataFrame, latencies: tuple[int, ...] = (100,), cancel_ms: int = 100, models: tuple[str, ...] = ("touch", "conservative")
) -> DataFrame:
    """Fills of resting orders (market, order_id, ms, side, price, qty, ahead, cancel_at) by prints, for every model and latency.

    An order rests from ``ms + latency`` and can be filled until its cancel takes effect. A print that takes the
    other side reaches orders at its price or better for it, best price first, then first come; ``conservative`` first
    uses up the contracts ahead at the order's own price, ``touch`` fills as soon as the price is reached. The intents
    are the same in every scenario: no fill feeds back into them.
    """

    if min(latencies, default=0) < 0:
        raise ValueError(f"an order can't rest before it is sent: latencies {latencies}")

    def run(batches):
        import bisect

        import pyarrow as pa

        kinds = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for c in FILLS.split(", ")])
        scenarios = [(model, latency) for model in models for latency in latencies]
        market, sent, books = (), {}, {}
        for batch in batches:
            out = []
            for key, id_, ms, side, price, qty, ahead, cancel_at, is_print in zip(*[batch.column(c).to_pylist() for c in ("market", "id", "ms", "side", "price", "qty", "ahead", "cancel_at", "is_print")], strict=True):
                if key != market:
                    # per side the orders as they were sent, and per scenario how many of them rest already, and those, best first
                    market, sent = key, {"bid": [], "ask": []}
                    books = {s: [[model == "conservative", model, latency, 0, []] for model, latency in scenarios] for s in sent}
                if side not in sent or ms is None or price is None or qty is None:
                    continue  # neither an order nor a print
                sign = -1.0 if side == "bid" else 1.0
                if not is_print:
                    sent[side].append((sign * price, ms, id_, len(sent[side]), price, qty, 0.0 if ahead is None else ahead, float("inf") if cancel_at is None else cancel_at + cancel_ms))
                    continue
                orders, reach = sent[side], sign * price
                for book in books[side]:
                    queued, model, latency, upto, resting = book
                    while upto < len(orders) and orders[upto][1] + latency < ms:
                        bisect.insort(resting, list(orders[upto]))
                        upto += 1
                    book[3] = upto
                    left, gone = qty, []
                    for i, o in enumerate(resting):
                        if left <= 0 or o[0] > reach:
                            break
                        if o[7] < ms:
                            gone.append(i)
                            continue
                        available = left
                        if queued and o[4] == price:
                            used = min(o[6], available)
                            o[6] -= used
                            available -= used
                        got = min(o[5], available)
                        if got > 0:
                            o[5] -= got
                            left -= got
                            out.append((key, o[2], id_, ms, o[4], got, model, latency))
                        if o[5] <= 0:
                            gone.append(i)
                    for i in reversed(gone):
                        del resting[i]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    double = lambda c: F.col(c).cast("double").alias(c)
    own = orders.select("market", F.col("order_id").alias("id"), "ms", "side", double("price"), double("qty"), double("ahead"), "cancel_at", F.lit(False).alias("is_print"))
    hits = trades.select("market", F.col("trade_id").alias("id"), "ms", F.col("hits").alias("side"), double("price"), F.col("size").cast("double").alias("qty"), F.lit(True).alias("is_print"))
    tasks = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(hits, allowMissingColumns=True).repartition(tasks, "market").sortWithinPartitions("market", "ms", "is_print", "id")
    return dealt.mapInArrow(run, FILLS)


def lifecycle(actions: DataFrame, events: DataFrame, latency_ms: int = 100, cancel_ms: int = 100, on_gap: str = "cancel_all") -> DataFrame:
    """States of every order through submits, cancels, replaces, prints and gaps; one row per change, ``seq`` from 0.

    Actions: (market, seq, ms, kind, order_id, target, side, price, qty), kind ``submit``, ``cancel`` or ``replace``;
    cancel and replace name the order they mean as ``target``. Events: (market, seq, ms, kind, side, price, size), kind
    ``trade`` (side: the resting side it reaches) or ``gap``. An action takes effect after its latency, cancels before
    activations at equal instants, and both before market events of a later instant but after those of the same one:
    ties go against the order. A replace cancels its target and submits what is left of it under the new id, at the new
    price. Rejected: an id seen before, no quantity, a price outside [0, 1], a target that is not resting. At a gap
    ``cancel_all`` cancels what rests, ``keep_resting`` leaves it, ``freeze`` fills nothing more in that market.
    """
    if on_gap not in ("cancel_all", "keep_resting", "freeze"):
        raise ValueError(f"unknown gap policy {on_gap}")

    def run(key, acts, feed):
        import pandas as pd

        out, resting, known, count, frozen = [], {}, set(), {}, False

        def state(order, ms, name, qty, price):
            out.append((key[0], order, count.get(order, 0), ms, name, qty, price))
            count[order] = count.get(order, 0) + 1

        queue = []
        for a in acts.itertuples():
            late = latency_ms if a.kind == "submit" else cancel_ms
            queue.append((a.ms + late, 1, 1 if a.kind == "submit" else 0, a.seq, a))
        for e in feed.itertuples():
            queue.append((e.ms, 0, 0, e.seq, e))
        for ms, source, _, _, x in sorted(queue, key=lambda q: q[:4]):
            if source == 0 and x.kind == "gap":
                frozen = frozen or on_gap == "freeze"
                if on_gap == "cancel_all":
                    for order in list(resting):
                        o = resting.pop(order)
                        state(order, ms, "cancelled_by_gap", o[2], o[1])
            elif source == 0:
                left = 0.0 if frozen else float(x.size)
                sign = -1 if x.side == "bid" else 1
                reached = [i for i, o in resting.items() if o[0] == x.side and sign * o[1] <= sign * x.price]
                for order in sorted(reached, key=lambda i: (sign * resting[i][1], resting[i][3], i)):
                    if left <= 0:
                        break
                    o = resting[order]
                    got = min(left, o[2])
                    left, o[2] = left - got, o[2] - got
                    state(order, ms, "filled" if o[2] <= 0 else "partly_filled", got, o[1])
                    if o[2] <= 0:
                        del resting[order]
            else:
                qty, side = x.qty, x.side
                if x.kind != "submit":
                    o = resting.pop(x.target, None)
                    if o is None:
                        state(x.order_id, ms, "rejected", 0.0, x.price)
                        continue
                    state(x.target, ms, "cancelled" if x.kind == "cancel" else "replaced", o[2], o[1])
                    if x.kind == "cancel":
                        continue
                    qty, side = o[2], o[0]
                if x.order_id in known or not qty > 0 or not 0 <= x.price <= 1:
                    state(x.order_id, ms, "rejected", 0.0, x.price)
                    continue
                known.add(x.order_id)
                resting[x.order_id] = [side, float(x.price), float(qty), ms]
                state(x.order_id, ms, "resting", float(qty), x.price)
        for order, o in resting.items():
            state(order, max((q[0] for q in queue), default=0), "open_at_end", o[2], o[1])
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATES.split(", ")])

    return _by_market(actions).cogroup(_by_market(events)).applyInPandas(run, STATES)
