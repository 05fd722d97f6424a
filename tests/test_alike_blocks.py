"""Blocks of token sets: pairs against a loop, what is compared, and what is shuffled."""

import random

import numpy as np
import pytest

from emberline.operators import alike, families
from emberline.operators.alike import Block, alike_sets, keys_of
from emberline.operators.families import alike_pairs


def blocks_of(parts):
    """Blocks of lists of sets (of numbers that stand for hashes)."""
    counts = np.bincount([t % 64 for p in parts for s in p for t in s], minlength=64)
    sketch = np.minimum(63, 2 * np.log2(counts + 1)).astype(np.uint8)
    found = []
    for sets in parts:
        sizes = np.array([len(s) for s in sets], np.int32)
        keys = keys_of(np.array([(t << 6) | (t % 64) for s in sets for t in s], np.int64), sketch)
        found.append(Block(sizes, *Block.of(keys, sizes)))
    return found


@pytest.mark.parametrize("chunk", [1 << 22, 7])
def test_sets_equal_a_loop(monkeypatch, chunk):
    monkeypatch.setattr(alike, "CHUNK", chunk)
    monkeypatch.setattr(alike, "MARKS", 64 if chunk > 7 else 3)
    draw = random.Random(3)

    def some(n):
        made = []
        for _ in range(n):
            kind = draw.random()
            made.append(set(draw.sample(range(40), draw.randint(1, 5))) if kind < 0.3 else set(draw.sample(range(20), draw.randint(15, 20))) if kind < 0.7 else set(draw.sample(range(300), draw.randint(5, 60))))
        return sorted(made, key=len)

    left, right = some(90), some(70)
    a, b = blocks_of([left, right])

    def want(small, large, same, strict):
        found = set()
        for i, s in enumerate(small):
            for j, t in enumerate(large):
                both, fits = len(s & t), (i < j if same else len(s) < len(t) if strict else len(s) <= len(t))
                if fits and both and (both * 100 >= len(s | t) * 86 or both * 100 >= len(s) * 92):
                    found.add((i, j))
        return found

    for sides, same, strict in (((a, a), True, False), ((a, b), False, False), ((b, a), False, True)):
        got = list(zip(*(x.tolist() for x in alike_sets(*sides, same, strict, 86, 92))))
        plain = [left if s is a else right for s in sides]
        assert set(got) == want(*plain, same, strict) and len(got) == len(set(got)) and len(got) > 20


def test_one_shared_rare_token_compares_no_set(monkeypatch):
    compared = []
    common = alike._common
    monkeypatch.setattr(alike, "_common", lambda *x: compared.append(len(x[3])) or common(*x))
    sets = [{i // 10} | {100 + (i * 70 + k) for k in range(60)} for i in range(200)]
    (block,) = blocks_of([sets])
    assert not len(alike_sets(block, block, True, False, 86, 92)[0]) and compared == [0]


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_meeting_tokens_are_not_shuffled(spark):
    """Before, a row for each two holders of a token was shuffled, which grows with the square of a topic."""
    draw = random.Random(5)
    sets = [("t", i, [f"w{x}" for x in draw.sample(range(250), 100)]) for i in range(1500)]
    df = spark.createDataFrame(sets, "topic string, id bigint, tokens array<string>").repartition(4).cache()
    df.count()
    start = shuffled(spark)
    assert alike_pairs(df).count() == 0
    assert shuffled(spark) - start < 4 << 20


def test_blocks_of_one_topic_meet(spark, monkeypatch):
    monkeypatch.setattr(families, "TOKENS_HELD", 300)
    draw = random.Random(6)
    sets = [(draw.choice("xy"), i, sorted({f"w{x}" for x in draw.sample(range(12), draw.randint(1, 12))})) for i in range(300)]
    sets = [s for i, s in enumerate(sets) if s[2] not in [r[2] for r in sets[:i] if r[0] == s[0]]]
    want = set()
    for t, i, s in sets:
        for u, j, v in sets:
            both, n, m = len(set(s) & set(v)), len(s), len(v)
            if t == u and (n, i) < (m, j) and (both * 100 >= (n + m - both) * 86 or both * 100 >= n * 92) and both:
                want.add((t, i, j))
    df = spark.createDataFrame(sets, "topic string, id bigint, tokens array<string>")
    got = [tuple(r) for r in alike_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 100
    tree = {(r.topic, *((r.a, r.b) if (r.topic, r.a, r.b) in want else (r.b, r.a))) for r in alike_pairs(df, forest=True).collect()}

    def parts(edges):
        low = {(t, i): i for t, i, _ in sets}
        for _ in sets:
            for t, i, j in edges:
                low[t, i] = low[t, j] = min(low[t, i], low[t, j])
        return low

    assert tree <= want and len(tree) < len(want) and parts(tree) == parts(want)


def test_only_titles_of_repeated_ids_are_exchanged(spark):
    draw = random.Random(7)
    rows = [("t", i, " ".join(f"{draw.randrange(10**9):x}" for _ in range(200))) for i in range(2000)]
    df = spark.createDataFrame(rows + rows[:3] + [("t", None, "x"), (None, 5, "y")], "topic string, id bigint, title string").repartition(4).cache()
    df.count()
    start = shuffled(spark)
    got = families._clean(df).select("topic", "id", "tokens").collect()
    assert shuffled(spark) - start < 1 << 20
    assert len(got) == 2001 and {(r.topic, r.id) for r in got} == {("t", i) for i in range(2000)} | {("", 5)}


def test_families_of_copies_need_no_link_for_each_pair(spark, monkeypatch):
    held = []
    join = families.components
    monkeypatch.setattr(families, "components", lambda edges: held.append(edges.count()) or join(edges))
    rows = [("t", i, " ".join(f"w{k}" for k in range(30)) + f" own{i}") for i in range(100)]
    got = families.title_families(spark.createDataFrame(rows, "topic string, id bigint, title string")).collect()
    assert {r.family for r in got} == {0} and len(got) == 100 and held == [99]
