"""Greedy terms from a group's first terms equal those from all of them."""

import random

from emberline.operators import rules


def greedy(rows, most):
    best = {}
    for g, term, w in rows:
        best[g, term] = max(w, best.get((g, term), w))
    found = []
    for g in sorted({g for g, _ in best}):
        chosen = []
        for term, w in sorted(((t, w) for (h, t), w in best.items() if h == g), key=lambda x: (-x[1] * (1.15 if " " in x[0] else 1.0), x[0])):
            mine = {*term.split(" ")}
            if len(chosen) < most and not any((mine <= c) != (c <= mine) for c in chosen):
                chosen.append(mine)
                found.append((g, len(chosen), term, w))
    return found


def test_short_and_long_starts(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(draw.choice("xy"), " ".join(draw.sample("abcdefgh", draw.choice([1, 2, 2]))), float(draw.randint(1, 40))) for _ in range(150)] + [("z", "a", 1.0), ("z", "a b", 1.0)]
    df = spark.createDataFrame(rows, "source string, term string, weight double")
    want = greedy(rows, 6)
    for first in (1, 7, 1000):
        monkeypatch.setattr(rules, "FIRST_TERMS", first)
        assert sorted(map(tuple, rules.ranked_terms(df, 6).collect())) == want
