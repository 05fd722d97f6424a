"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from emberline.llm import phrases
from emberline.llm.phrases import collocations, phrase_counts


def plainly(rows, least=10, longest=3, share=50, keep=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    result = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {}
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside.get(p[i : i + size], 0), a)
        scored = []
        for p, a in candidates.items():
            if 100 * inside.get(p, -1) >= share * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:keep], 1):
            result.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return result


def some_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "é", "漢", "a\x00b", "x", "\x1cq", "'s"]
    rows = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "!"]) for _ in range(rng.randrange(80)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, " . "), ("fr", "only words under ten"), ("es", "la la la " * 40), ("es", "la la la " * 40)]


@pytest.mark.parametrize("keep,longest", [(2000, 3), (7, 3), (2000, 2)])
def test_equals_plain_counting(spark, keep, longest):
    rows = some_rows(1)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, f int, phrase int").repartition(5)
    got = {tuple(r) for r in collocations(docs, keep=keep, longest=longest).collect()}
    assert got == plainly(rows, keep=keep, longest=longest)


def test_a_sketch_full_of_collisions_loses_nothing(spark, monkeypatch):
    for name, value in (("LEAST_CELLS", 64), ("BYTES_PER_CELL", 1 << 40)):
        monkeypatch.setattr(phrases, name, value)
    rows = some_rows(2)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in collocations(docs).collect()} == plainly(rows)


def test_long_texts_are_read_in_parts_that_share_their_border(monkeypatch):
    monkeypatch.setattr(phrases, "AT_ONCE", 50)
    text = b" ".join(random.Random(3).choice([b"a", b"bb", b"ccc", b"d.", b"longlonglonglonglonglonglonglonglonglonglonglonglong"]) for _ in range(3000))
    found = Counter()
    for words, keys, sizes, counts in phrases._grams([text], 3):
        numbers = phrases._numbers(keys, 3)
        for i in range(len(keys)):
            found[b" ".join(words[n[i]] for n in numbers[: sizes[i]])] += int(counts[i])
    plain = Counter()
    for piece in text.split(b"."):
        words = piece.split()
        for size in (1, 2, 3):
            plain.update(b" ".join(words[i : i + size]) for i in range(len(words) - size + 1))
    assert found == plain


def test_cells_add_up_and_stop():
    cells = np.zeros(8, np.uint8)
    phrases._add(cells, np.array([1, 1, 3, 1]), np.array([4, 5, 2, 900]), 10)
    phrases._add(cells, np.array([3]), np.array([3]), 10)
    assert cells.tolist() == [0, 10, 0, 5, 0, 0, 0, 0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations(empty).count() == 0 and phrase_counts(empty).count() == 0
    with pytest.raises(ValueError):
        phrase_counts(empty, longest=4)
