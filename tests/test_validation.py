"""Running books, rewinding, polled books and replay from seeds, against plain folds over random streams."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidebook.operators import rewind, seeds, ticks


def dec(x):
    return Decimal(str(x)).quantize(Decimal("0.000001"))


def test_running_aggregates_in_blocks_equal_those_in_one_piece(spark):
    rng = random.Random(1)
    rows = [(k if k else None, i // 3, rng.randrange(1 << 40) if rng.random() < 0.8 else None) for k in (0, 1, 2) for i in range(60)]
    table = spark.createDataFrame(rows, "k long, at long, v long")
    columns = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "x": ("bit_xor", F.col("v"))}
    whole, cut = (sorted(map(tuple, ticks.running(table, ["k"], "at", columns, b).collect()), key=repr) for b in (None, F.col("at").cast("long") - F.col("at") % 4))
    assert whole == cut
    for k, at, v, s, m, x in whole:
        upto = [r[2] for r in rows if r[0] == k and r[1] <= at and r[2] is not None]
        want = 0
        for u in upto:
            want ^= u
        assert (s, m, x) == ((sum(upto), max(upto), want) if upto else (None, None, None))


def stream(rng, n=80):
    """Changes of one market that never make a level negative: (at, ms, side, price, delta)."""
    book, out, ms = defaultdict(int), [], 0
    for at in range(1, n + 1):
        ms += rng.choice((0, 1, 5, 40))
        level = rng.choice("yn"), rng.choice((1, 2, 62, 63, 99))
        delta = rng.randint(-book[level], 4)
        book[level] += delta
        out.append((at, ms, {"y": "yes", "n": "no"}[level[0]], dec(level[1] / 100), dec(delta)))
    return out


def with_sizes(rows):
    sizes, out = defaultdict(Decimal), []
    for at, ms, side, price, delta in rows:
        pre = sizes[side, price]
        sizes[side, price] += delta
        out.append((1, 1, at, ms, side, price, dec(pre), dec(pre + delta)))
    return out


CHANGES = "market long, epoch long, at long, ms long, side string, price decimal(12,6), pre decimal(24,6), post decimal(24,6)"


@pytest.mark.parametrize("block", [None, "at div 7"])
def test_books_after_each_change(spark, block):
    rows = with_sizes(stream(random.Random(3)))
    table = spark.createDataFrame([*rows, (1, 1, 0, 0, None, None, None, None), (2, 1, 5, 0, None, None, None, None)], CHANGES)
    got = {(r.market, r["at"]): r for r in ticks.after_each(table, ["market", "epoch"], "at", block=None if block is None else F.expr(block)).collect()}
    sizes, marks = {}, {}
    for _, _, at, _, side, price, _, post in rows:
        sizes[side, price] = post
        held = {k: v for k, v in sizes.items() if v}
        r = got[1, at]
        yes, no = (max((p for s, p in held if s == side), default=None) for side in ("yes", "no"))
        assert (r.bid, r.bid_size) == (yes, held.get(("yes", yes))) and (r.ask, r.ask_size) == (None if no is None else 1 - no, held.get(("no", no)))
        assert (r.yes_levels, r.no_levels) == tuple(sum(s == side for s, _ in held) for side in ("yes", "no"))
        marks.setdefault(tuple(r.mark), set()).add(tuple(sorted(held.items())))
    assert all(len(v) == 1 for v in marks.values()) and len(marks) == len({v for s in marks.values() for v in s})
    empty = got[2, 5]
    assert (empty.bid, empty.ask, empty.yes_levels, tuple(empty.mark)) == (None, None, 0, (0, 0))
    held = {(s, p): v for (s, p), v in sizes.items()}
    as_levels = spark.createDataFrame([(9, s, p, v) for (s, p), v in held.items()], "id long, side string, price decimal(12,6), size decimal(24,6)")
    assert ticks.book_marks(as_levels, ["id"]).first().mark == got[1, rows[-1][2]].mark


def test_a_price_off_the_ticks_is_an_error(spark):
    for price in ("0.015", "1.30", "0"):
        table = spark.createDataFrame([(1, 1, 1, 1, "yes", dec(price), dec(0), dec(1))], CHANGES)
        with pytest.raises(Exception, match="off the ticks"):
            ticks.after_each(table, ["market", "epoch"], "at").collect()
    fine = spark.createDataFrame([(1, 1, 1, 1, "yes", dec("0.015"), dec(0), dec(1))], CHANGES)
    assert ticks.after_each(fine, ["market", "epoch"], "at", tick="0.001", ticks=1000).first().bid == dec("0.015")


def _past(spark, rows):
    after = ticks.after_each(spark.createDataFrame(with_sizes(rows), CHANGES), ["market", "epoch"], "at", sizes=False)
    first = spark.createDataFrame([(1, 1, 0, 0)], "market long, epoch long, at long, ms long").withColumn("mark", F.expr(ticks.EMPTY))
    return rewind.history(after, first)


def test_rewind_equals_undoing_one_change_after_the_other(spark):
    rng = random.Random(7)
    rows = stream(rng)
    asks = [(i, 1, now, now - back) for i, (now, back) in enumerate([(rows[-1][1], 10_000), (rows[40][1], 60), (rows[40][1] + 3, 0), (0, 5), (-1, 5), (rows[-1][1] + 500, 90), (rows[10][1], 9_999)])]
    found = defaultdict(list)
    limits = {"window_ms": 300, "changes": 20, "states": 12}
    for r in rewind.rewind(spark.createDataFrame(asks, "ask_id long, market long, now_ms long, from_ms long"), _past(spark, rows), **limits).collect():
        found[r.ask_id].append((r.k, r.at_ms, r["at"], tuple(r.mark)))
    marks = {r["at"]: tuple(r.mark) for r in _past(spark, rows).collect()}
    for ask, _, now, since in asks:
        done = [r for r in rows if r[1] <= now]
        if now < 0:
            assert ask not in found
            continue
        last = done[-1][1] if done else 0
        journal = [r for r in done if r[1] >= last - 300][-20:]
        want = [(0, last, done[-1][0] if done else 0, marks[done[-1][0] if done else 0])]
        for i in range(len(journal) - 1, -1, -1):
            if len(want) == 12 or journal[i][1] < since:
                break
            before = journal[i - 1] if i else None
            want.append((len(want), before[1] if before else journal[i][1], before[0] if before else None, marks[journal[i][0] - 1]))
        assert sorted(found[ask]) == want


def test_polled_books_need_two_mismatches_to_be_confirmed(spark):
    """Matches now, some changes ago, never; the third mismatch in a row is a first one again, the fourth escalates."""
    rows = [(i, i * 1000, "yes", dec("0.40"), dec(1)) for i in range(1, 21)]
    past = _past(spark, rows)
    mark = {r["at"]: r.mark for r in past.collect()}
    spoilt = (1, 2)
    polls = [(1, 5_000, mark[5]), (2, 6_500, mark[4]), (3, 7_000, mark[1]), (4, 8_000, spoilt), (5, 9_000, spoilt), (6, 10_000, spoilt), (7, 11_000, mark[11]), (8, 12_000, spoilt), (9, 13_000, spoilt), (10, 900, mark[1])]
    table = spark.createDataFrame([(i, 1, t1 - 100, t1, tuple(m)) for i, t1, m in polls], "poll_id long, market long, t0 long, t1 long, polled struct<a: bigint, b: bigint>")
    valid = spark.createDataFrame([(1, 0, True), (1, 1_000_000, False)], "market long, ms long, ok boolean")
    got = {r.poll_id: r for r in rewind.validated(table, past, valid, tolerance_ms=1500).collect()}
    assert {i: (r.kind.removeprefix("mismatch_"), r.matched_at_ms, r.consecutive_confirmed, r.escalate) for i, r in got.items()} == {
        1: ("match_current", None, None, False), 2: ("match_recent", 4000, None, False), 3: ("transient", None, None, False), 4: ("confirmed", None, 1, False),
        5: ("transient", None, None, False), 6: ("confirmed", None, 2, True), 7: ("match_current", None, None, False), 8: ("transient", None, None, False),
        9: ("confirmed", None, 1, False), 10: ("transient", None, None, False),
    }
    assert (got[1].states_considered, got[10].states_considered) == (1, 1) and got[3].states_considered > 1
    late = spark.createDataFrame([(1, 1_000_100, True)], "market long, ms long, ok boolean")
    assert rewind.validated(table, past, late).count() == 0  # books that nobody trusts are not compared


# ---- replay from seeds


def fold(request, snapshots, levels, deltas, strict=False):
    """One request by the definition, event by event."""
    rid, market, from_ms, to_ms, to_stream, to_seq = request
    place = lambda x: (x["ms"], x["started_ms"], x["stream"], x["seq"])
    own = sorted((s for s in snapshots if s["market"] == market), key=place)
    early = [s for s in own if s["ms"] <= from_ms]
    late = [s for s in own if from_ms < s["ms"] <= to_ms]
    warnings = [] if early else [("late seed" if late else "no seed", None)]
    if not early and not late:
        return [], warnings
    seed = early[-1] if early else late[0]
    later = [s for s in own if seed["ms"] < s["ms"] <= to_ms and s["source"] != "local_materialized"]
    moves = sorted((d for d in deltas if d["market"] == market and seed["ms"] <= d["ms"] <= to_ms and place(d) > place(seed)), key=place)
    frames, segment = [], 0

    def take(s):
        nonlocal book, valid, segment
        book, valid, segment = {(side, p): v for side, p, v in levels[s["snapshot_id"]]}, True, segment + 1
        emit(s, True)

    def emit(x, head):
        if x["ms"] >= from_ms:
            held = {k: v for k, v in book.items() if v}
            yes, no = (max((p for s, p in held if s == side), default=None) for side in ("yes", "no"))
            frames.append((rid, segment, x["ms"], x["stream"], x["seq"], head, valid, yes, held.get(("yes", yes)), None if no is None else 1 - no, held.get(("no", no)), len(held)))

    book, valid, reached, stopped = {}, True, to_stream is None, False
    take(seed)
    for d in moves:
        if to_seq is not None:
            on = to_stream is None or d["stream"] == to_stream
            if (on and d["seq"] > to_seq) or (not on and reached):
                stopped = True
                break
            reached |= on
        while later and place(later[0]) <= place(d):
            take(later.pop(0))
        if not d["applied"]:
            if strict:
                warnings.append(("not applied", d["delta_id"]))
            continue
        level = d["side"], d["price"]
        after = book.get(level, Decimal(0)) + d["delta"]
        if after < 0:
            valid = False
            warnings.append(("diverged", d["delta_id"]))
            if strict:
                stopped = True
                break
            continue
        book[level] = after
        emit(d, False)
    if not stopped:
        for s in later:
            take(s)
    return frames, warnings


@pytest.mark.parametrize("strict", [False, True])
def test_seeded_replay_equals_a_fold(spark, strict):
    rng = random.Random(11)
    snapshots, levels, deltas, n = [], {}, [], 0
    for market in range(6):
        ms = 0
        for stream_no in range(3):
            started, seq = ms, 0
            for _ in range(rng.randrange(10, 30)):
                ms, seq, n = ms + rng.choice((0, 3)), seq + 1, n + 1
                row = {"market": market, "ms": ms, "started_ms": started, "stream": (stream_no * 7 + market) % 5, "seq": seq}
                if rng.random() < 0.2:
                    source = rng.choice(("ws_initial", "ws_recovery", "session_handoff", "local_materialized"))
                    snapshots.append(row | {"snapshot_id": n, "source": source})
                    levels[n] = [(s, dec(p / 100), dec(rng.randrange(1, 5))) for s in ("yes", "no") for p in rng.sample((1, 2, 63), rng.randrange(3))]
                else:
                    deltas.append(row | {"delta_id": n, "side": rng.choice(("yes", "no")), "price": dec(rng.choice((1, 2, 63)) / 100), "delta": dec(rng.randrange(-2, 3)), "applied": rng.random() < 0.9})
    requests = [(i, m, f, t, s, q) for i, (m, f, t, s, q) in enumerate((m, f, t, s, q) for m in range(6) for f, t in ((0, 1000), (20, 60)) for s, q in ((None, None), (m % 5, 4), (None, 6), (99, 2)))]
    requests.append((999, 77, 0, 10, None, None))
    want = [fold(r, snapshots, levels, deltas, strict) for r in requests]
    put = spark.createDataFrame
    frames, epochs, warnings = seeds.replayed(
        put(requests, "request_id long, market long, from_ms long, to_ms long, to_stream long, to_seq long"),
        put([tuple(s[c] for c in ("snapshot_id", "market", "ms", "started_ms", "stream", "seq", "source")) for s in snapshots], "snapshot_id long, market long, ms long, started_ms long, stream long, seq long, source string"),
        put([(i, *x) for i, own in levels.items() for x in own], "snapshot_id long, side string, price decimal(12,6), size decimal(24,6)"),
        put([tuple(d[c] for c in ("delta_id", "market", "ms", "started_ms", "stream", "seq", "side", "price", "delta", "applied")) for d in deltas],
            "delta_id long, market long, ms long, started_ms long, stream long, seq long, side string, price decimal(12,6), delta decimal(24,6), applied boolean"), strict)
    got = sorted((r.request_id, r.segment, r.ms, r.stream, r.seq, r.seed, r.valid, r.bid, r.bid_size, r.ask, r.ask_size, r.yes_levels + r.no_levels) for r in frames.collect())
    assert [repr(x) for x in got] == [repr(x) for x in sorted(x for f, _ in want for x in f)]
    said = sorted(((r.request_id, r.warning, r.delta_id) for r in warnings.collect()), key=repr)
    assert said == sorted(((req[0], *w) for req, (_, ws) in zip(requests, want, strict=True) for w in ws), key=repr)
    assert sum(w == "diverged" for _, w, _ in said) > 3 and {"late seed", "no seed"} <= {w for _, w, _ in said}
    assert epochs.where("deltas_applied > 0").count() > 0
