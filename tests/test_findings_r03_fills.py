"""Fills of resting orders by their definition, on random orders and prints."""

import itertools
import random

from tidebook.operators import execution


def test_fills_by_their_definition(spark):
    rng = random.Random(3)
    orders = [(m, i, rng.randrange(60), rng.choice(("bid", "ask")), rng.randrange(3, 7) / 10, float(rng.randrange(1, 6)), float(rng.randrange(4)), rng.choice((None, 20, 40))) for m in (1, 2) for i in range(40)]
    prints = [(m, 100 + i, rng.randrange(60), rng.choice(("bid", "ask")), rng.randrange(3, 7) / 10, float(rng.randrange(1, 9))) for m in (1, 2) for i in range(25)]
    want = set()
    for model, latency, m, side in itertools.product(("touch", "conservative"), (0, 5), (1, 2), ("bid", "ask")):
        sign = -1 if side == "bid" else 1
        book = [dict(zip(("m", "id", "ms", "side", "price", "left", "ahead", "cancel"), o, strict=True)) for o in sorted(orders, key=lambda o: (sign * o[4], o[2], o[1])) if o[0] == m and o[3] == side]
        for _, trade, ms, _, paid, left in sorted((p for p in prints if p[0] == m and p[3] == side), key=lambda p: (p[2], p[1])):
            for o in book:
                if o["left"] <= 0 or sign * o["price"] > sign * paid or not o["ms"] + latency < ms or (o["cancel"] is not None and o["cancel"] + 10 < ms) or left <= 0:
                    continue
                free = left
                if model == "conservative" and o["price"] == paid:
                    free, o["ahead"] = free - min(o["ahead"], free), o["ahead"] - min(o["ahead"], free)
                if (got := min(o["left"], free)) > 0:
                    o["left"], left = o["left"] - got, left - got
                    want.add((m, o["id"], trade, ms, o["price"], got, model, latency))
    o = spark.createDataFrame(orders, "market long, order_id long, ms long, side string, price double, qty double, ahead double, cancel_at long")
    p = spark.createDataFrame(prints, "market long, trade_id long, ms long, hits string, price double, size double")
    found = execution.simulate(o, p, latencies=(0, 5), cancel_ms=10)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 100
