"""Recovery episodes against a store that counts its calls."""

import random

from pyspark.sql import Row

from tidebook.streaming import timed


class Store:
    """A handle, and its states: every call is counted."""

    def __init__(self):
        self.calls, self.timers, self.values, self.maps = 0, set(), {}, {}

    def _hit(self, out=None):
        self.calls += 1
        return out

    def getValueState(self, name, schema):
        return _Value(self)

    def getMapState(self, name, *schemas):
        return _Map(self)

    def listTimers(self):
        return self._hit(list(self.timers))

    def registerTimer(self, at):
        self._hit(self.timers.add(at))

    def deleteTimer(self, at):
        self._hit(self.timers.remove(at))


class _Value:
    def __init__(self, store):
        self.store, self.value = store, None

    def exists(self):
        return self.store._hit(self.value is not None)

    def get(self):
        return self.store._hit(self.value)

    def update(self, value):
        self.store._hit()
        self.value = value


class _Map:
    def __init__(self, store):
        self.store, self.items = store, {}

    def keys(self):
        return iter(self.store._hit(list(self.items)))

    def containsKey(self, key):
        return self.store._hit(key in self.items)

    def updateValue(self, key, value):
        self.store._hit(self.items.update({key: value}))

    def removeKey(self, key):
        self.store._hit(self.items.pop(key))

    def clear(self):
        self.store._hit(self.items.clear())


def frames(n):
    rng = random.Random(2)
    kinds = ("gap", "request", "snapshot", "snapshot", "frame", "frame", "end", "unavailable")
    return [Row(ordinal=i, ms=i * 10, kind=rng.choices(kinds, (4, 6, 6, 6, 6, 6, 1, 1))[0], market=rng.randrange(3), affected=[0, 1, 2]) for i in range(n)]


def run(batches):
    store, out = Store(), []
    flow = timed.Episodes(60)
    flow.init(store)
    for rows in batches:
        out += [tuple(r) for r in flow.handleInputRows((1,), iter(rows), None)]
        assert len(store.timers) <= 1
    return out, store.calls


def test_a_batch_costs_few_calls_of_the_store_and_batches_tell_the_same():
    rows = frames(500)
    whole, calls = run([list(reversed(rows))])
    each, _ = run([[r] for r in rows])
    assert whole == each and {"opened", "requested", "snapshot", "completed", "timeout", "superseded"} <= {r[3] for r in whole}
    assert calls <= 10
