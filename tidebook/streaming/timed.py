"""Stateful flows with event-time timers: recovery episodes with an outstanding set, and books sampled on a clock.

State is kept per key in the session's state store, an episode's outstanding markets and a book's levels as map entries: a batch reads
a key's once and writes back what it has changed, as every call of the store is a trip from Python to the JVM. Timers run on the watermark: a stream or market that falls silent still
times out and is still sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The state store that keeps maps and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPISODES = "stream long, episode long, ms long, event string, state string, opened_ms long, outstanding int, snapshots int, withheld int"
SAMPLES = "market long, bucket_ms long, valid boolean, bid long, bid_size long, ask long, ask_size long, levels int, written boolean"


def with_store(spark: SparkSession) -> None:
    """Streams of this session that start from now on keep maps and timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _retimed(handle, due: int | None) -> None:
    """Let the key's one timer be due at ``due``, or none."""
    for (at,) in [tuple(t) if isinstance(t, (tuple, list)) else (t,) for t in handle.listTimers()]:
        if at != due:
            handle.deleteTimer(at)
    if due is not None:
        handle.registerTimer(due)


class Episodes(StatefulProcessor):
    """Recovery of one stream: HEALTHY, DEGRADED at a gap, RECOVERING once asked for, HEALTHY when the last affected market is restored.

    A gap while an episode is open belongs to it. An episode that is not through ``timeout_ms`` after it was asked for - or opened,
    where nobody has asked - ends and leaves the stream DEGRADED, and the next gap opens another. Where no recovery can be had it ends as
    well; the end of a stream supersedes it.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "state string, episode long, is_open boolean, opened long, asked long, snapshots int, withheld int")
        self.waiting = handle.getMapState("waiting", "market long", "is_waiting boolean")

    def _load(self) -> dict:
        if self.machine.exists():
            return dict(zip(("state", "episode", "is_open", "opened", "asked", "snapshots", "withheld"), self.machine.get(), strict=True))
        return {"state": "healthy", "episode": 0, "is_open": False, "opened": None, "asked": None, "snapshots": 0, "withheld": 0}

    def _row(self, key, m: dict, ms: int, event: str, left: int) -> Row:
        return Row(stream=key[0], episode=m["episode"], ms=ms, event=event, state=m["state"], opened_ms=m["opened"], outstanding=left, snapshots=m["snapshots"], withheld=m["withheld"])

    def _due(self, m: dict) -> int | None:
        return (m["asked"] if m["asked"] is not None else m["opened"]) + self.timeout_ms if m["is_open"] else None

    def _expired(self, key, m: dict, left: int) -> Row:
        at = self._due(m)
        m.update(is_open=False, state="degraded")
        return self._row(key, m, at, "timeout", left)

    def _outstanding(self, m: dict) -> set:
        return {k[0] for k in self.waiting.keys()} if m["is_open"] else set()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        m, rows = self._load(), list(rows)
        waiting = self._outstanding(m)
        found, kept, due = dict(m), set(waiting), self._due(m)
        names = rows[0].__fields__ if rows else ()
        places = [names.index(c) for c in ("ordinal", "ms", "kind", "market", "affected")] if rows else []
        for _, ms, kind, market, affected in sorted(([r[i] for i in places] for r in rows), key=lambda r: r[0]):
            if m["is_open"] and ms >= self._due(m):
                yield self._expired(key, m, len(waiting))
                waiting.clear()
            if kind == "gap":
                if m["is_open"]:
                    m["withheld"] += 1
                    continue
                m.update(state="degraded", episode=m["episode"] + 1, is_open=True, opened=ms, asked=None, snapshots=0, withheld=0)
                waiting = set(affected or ())
                yield self._row(key, m, ms, "opened", len(waiting))
            elif kind == "end":
                if m["is_open"]:
                    yield self._row(key, m | {"state": "closed"}, ms, "superseded", len(waiting))
                    waiting.clear()
                m.update(state="healthy", is_open=False)
            elif not m["is_open"]:
                continue
            elif kind == "request" and m["state"] == "degraded":
                m.update(state="recovering", asked=ms)
                yield self._row(key, m, ms, "requested", len(waiting))
            elif kind == "unavailable":
                m.update(is_open=False, state="degraded")
                yield self._row(key, m, ms, "unavailable", len(waiting))
                waiting.clear()
            elif kind == "snapshot":
                if market is None or market not in waiting:
                    continue
                waiting.remove(market)
                m["snapshots"] += 1
                if not waiting:
                    m.update(is_open=False, state="healthy")
                yield self._row(key, m, ms, "snapshot" if waiting else "completed", len(waiting))
            elif kind == "frame":
                m["withheld"] += 1
        for market in kept - waiting:
            self.waiting.removeKey((market,))
        for market in waiting - kept:
            self.waiting.updateValue((market,), (True,))
        if m != found:
            self.machine.update(tuple(m.values()))
        if due != self._due(m):
            if due is not None:
                self.handle.deleteTimer(due)
            if m["is_open"]:
                self.handle.registerTimer(self._due(m))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        m = self._load()
        if m["is_open"]:
            yield self._expired(key, m, len(self._outstanding(m)))
            self.waiting.clear()
            self.machine.update(tuple(m.values()))

    def close(self) -> None:
        pass


def episodes(stream: DataFrame, timeout_ms: int) -> DataFrame:
    """What happened to each recovery episode of frames (stream, ordinal, at, ms, kind, market, affected), ``at`` watermarked.

    kind: ``gap`` (with the affected markets), ``request``, ``unavailable``, ``snapshot`` (of a market), ``frame`` or ``end``. Rows: opened,
    requested, snapshot, completed, timeout, unavailable, superseded, each with the state that it leaves.
    """
    with_store(stream.sparkSession)
    return stream.groupBy("stream").transformWithState(Episodes(timeout_ms), EPISODES, "append", "eventTime")


class Samples(StatefulProcessor):
    """A market's book at every multiple of ``step_ms`` from its first frame on, whether or not anything happened since.

    A frame at a boundary counts to it. An invalid book is sampled without prices. ``written`` says whether a full snapshot is due: the book
    is valid and, with ``suppress``, differs from the last one written.
    """

    def __init__(self, step_ms: int, suppress: bool = True):
        self.step_ms, self.suppress = step_ms, suppress

    def init(self, handle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "next long, valid boolean, last string")
        self.levels = handle.getMapState("levels", "side string, price long", "size long")

    def _sample(self, key, c: dict, book: dict) -> Row:
        import hashlib

        sides = {s: {p: v for (side, p), v in book.items() if side == s} for s in ("yes", "no")}
        yes, no = (max(sides[s], default=None) if c["valid"] else None for s in ("yes", "no"))
        text = hashlib.sha256(repr(sorted(book.items())).encode()).hexdigest()
        written = c["valid"] and not (self.suppress and text == c["last"])
        if written:
            c["last"] = text
        row = Row(market=key[0], bucket_ms=c["next"], valid=c["valid"], bid=yes, bid_size=sides["yes"].get(yes), ask=None if no is None else 1_000_000 - no,
                  ask_size=sides["no"].get(no), levels=len(book), written=written)
        c["next"] += self.step_ms
        return row

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        c = dict(zip(("next", "valid", "last"), self.clock.get() if self.clock.exists() else (None, False, None), strict=True))
        book = {tuple(k): v[0] for k, v in self.levels.iterator()}
        touched = set()
        for r in sorted(rows, key=lambda r: r.ordinal):
            if c["next"] is None:
                c["next"] = -(-r.ms // self.step_ms) * self.step_ms
            while c["next"] < r.ms:
                yield self._sample(key, c, book)
            if r.kind == "delta" and c["valid"]:
                level = (r.side, r.price)
                after = book.get(level, 0) + r.delta
                if after < 0:
                    c["valid"] = False
                else:
                    touched.add(level)
                    book.pop(level, None) if after == 0 else book.update({level: after})
            elif r.kind != "delta":
                touched |= book.keys()
                book, c["valid"] = {}, r.kind == "reset"
        for level in touched:
            if level in book:
                self.levels.updateValue(level, (book[level],))
            elif self.levels.containsKey(level):
                self.levels.removeKey(level)
        self.clock.update(tuple(c.values()))
        _retimed(self.handle, c["next"] + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        c = dict(zip(("next", "valid", "last"), self.clock.get(), strict=True))
        book = {tuple(k): v[0] for k, v in self.levels.iterator()}
        while c["next"] < timerValues.getCurrentWatermarkInMs():
            yield self._sample(key, c, book)
        self.clock.update(tuple(c.values()))
        _retimed(self.handle, c["next"] + 1)

    def close(self) -> None:
        pass


def samples(stream: DataFrame, step_ms: int, suppress: bool = True) -> DataFrame:
    """Samples of the books of frames (market, ordinal, at, ms, kind, side, price, delta), ``at`` watermarked; prices and sizes in millionths.

    kind: ``delta``, ``reset`` or ``down``. A book is valid from its first reset on, until a level would turn negative or the feed goes down.
    """
    with_store(stream.sparkSession)
    return stream.groupBy("market").transformWithState(Samples(step_ms, suppress), SAMPLES, "append", "eventTime")


def marked(frames: DataFrame, late: str = "1 hour") -> DataFrame:
    """frames with their instant ``at`` watermarked and ``ms``; late ones are kept for so long."""
    return frames.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
