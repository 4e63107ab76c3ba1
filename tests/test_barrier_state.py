"""The barrier of a batch asks the state store for groups of files, not for every file."""

import pandas as pd

from ledgerloom.streaming import intake as IN


class Store:
    """A map, a value and the number of calls, as the processor sees them."""

    def __init__(self):
        self.held, self.value, self.calls = {}, None, 0

    def getMapState(self, *_):
        return self

    getValueState = lambda self, *_: Value(self)

    def getValue(self, key):
        self.calls += 1
        return self.held.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.held


class Value:
    def __init__(self, store):
        self.store, self.now = store, None

    def get(self):
        self.store.calls += 1
        return self.now

    def update(self, value):
        self.store.calls += 1
        self.now = value

    def exists(self):
        self.store.calls += 1
        return self.now is not None


def test_calls_do_not_grow_with_every_file():
    store, barrier = Store(), IN._barrier()
    barrier.init(store)
    files = [f"f{i}" for i in range(2000)]

    def arrive(ids, expected=2001):
        parts = [pd.DataFrame({"file_id": ids[at : at + 1000], "expected": expected}) for at in range(0, len(ids), 1000)]
        return [tuple(r) for out in barrier.handleInputRows(("b",), iter(parts), None) for r in out.itertuples(index=False)]

    assert arrive(files) == [] and arrive([*files, None][::-1]) == [("b", 2001)] and arrive(["more"], 1) == []
    assert store.calls < 200
