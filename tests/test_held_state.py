"""Entries of a state map are read and written once a batch."""

from emberline.streaming import registry


class Counted:
    def __init__(self):
        self.rows, self.calls = {}, 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.rows

    def getValue(self, key):
        self.calls += 1
        return self.rows[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]


def test_each_entry_once(monkeypatch):
    state = Counted()
    held = registry.Held(state)
    for n in range(1000):
        held.put(f"m{n % 10}", ([n],))
    assert held.get("m3") == ([993],) and held.get("none") is None
    held.put("m4", None)
    held.flush()
    assert sorted(state.rows) == [(f"m{n}",) for n in range(10) if n != 4] and state.calls <= 25
    monkeypatch.setattr(registry, "MOST_HELD", 3)
    for n in range(40):
        held.put(f"m{n % 10}", ([*(held.get(f"m{n % 10}") or ([],))[0], n],))
    held.flush()
    assert state.rows["m4",] == ([4, 14, 24, 34],) and state.rows["m3",] == ([993, 3, 13, 23, 33],)
