"""Kneser-Ney ratios against a plain computation, and both scoring paths against each other."""

import math
import random
from collections import Counter

import pytest

from emberline.llm import toxicity as T


@pytest.fixture(scope="module")
def texts():
    r = random.Random(2)
    words = ["".join(r.choice("abcd\u00e9\u0130") for _ in range(r.randint(1, 7))) for _ in range(60)]
    return [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40))), int(r.random() < 0.4)) for i in range(60)] + [(60, None, 0), (61, "", 1), (None, "abc", 0), (3, "abc", 1)]


def plain_model(rows):
    """Interpolated Kneser-Ney of the highest order by class, continuation counts shared by the classes."""
    grams, n, d = Counter(), T.ORDER, T.DISCOUNT
    for _, text, toxic in rows:
        for w in T.WORD.findall((text or "").lower()):
            padded = "^" * (n - 1) + w + "$"
            for k in range(len(w) + 1):
                grams[padded[k : k + n], toxic] += 1
    kinds, levels = {g for g, _ in grams}, {}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in (kinds if k == n - 1 else levels[k + 1]))
    def lower(g):
        level = levels[len(g)]
        if len(g) == 1:
            return level[g] / sum(level.values())
        own = {x: c for x, c in level.items() if x[:-1] == g[:-1]}
        return (max(level[g] - d, 0) + d * len(own) * lower(g[1:])) / sum(own.values())
    known = {}
    for g in kinds:
        ratio = {}
        for c in (0, 1):
            own = {x: v for (x, t), v in grams.items() if t == c and x[:-1] == g[:-1]}
            total = sum(own.values())
            seen, rest = (max(own.get(g, 0) - d, 0) / total, d * len(own) / total) if total else (0, 1)
            ratio[c], known[g[:-1], c] = math.log(seen + rest * lower(g[1:])), math.log(rest)
        known[g] = ratio[1] - ratio[0]
    return {g if isinstance(g, str) else g[0]: v if isinstance(g, str) else known[g[0], 1] - known[g[0], 0] for g, v in known.items()}


def test_model_equals_plain_kneser_ney(spark, texts):
    frame = spark.createDataFrame([(t, x) for _, x, t in texts], "toxic int, text string")
    scored, unseen = T.kneser_ney(T.word_counts(frame))
    got, want = {r.gram: r.llr for r in scored.union(unseen).collect()}, plain_model(texts)
    assert got.keys() == want.keys() and all(abs(got[g] - want[g]) < 1e-9 for g in want)


def test_both_scoring_paths_agree(spark, texts):
    frame = spark.createDataFrame([(k, x, 1.0) for k, x, _ in texts], "doc_id long, text string, llr double")
    model = spark.createDataFrame(list(plain_model(texts).items()), "gram string, llr double")
    sort = lambda df: sorted(map(tuple, df.collect()), key=str)
    one, other = (sort(T.features(frame, model, "doc_id", "text", n)) for n in (10**6, 0))
    assert len(one) == len(texts)
    for a, b in zip(one, other, strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-9)
    known = {r.gram: r.llr for r in model.collect()}
    for key, *found in one:
        if key not in (None, 3):
            llrs = [T.word_llr(w, known) for w in T.WORD.findall((dict((k, x) for k, x, _ in texts)[key] or "").lower())]
            assert found[0] == pytest.approx(sum(llrs) / max(1, sum(map(len, T.WORD.findall((dict((k, x) for k, x, _ in texts)[key] or "").lower()))) + len(llrs)), abs=1e-9)
            assert found[1] == pytest.approx(max(llrs, default=0.0), abs=1e-9)


def test_hard_rows_and_names(spark, texts):
    rows = spark.createDataFrame([(k, x, t, 5, 6) for k, x, t in texts], "id long, body string, toxic int, _id int, _toxic int")
    labels = spark.createDataFrame([(k, t) for k, _, t in texts] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = T.score_toxicity(rows, labels, "id", "body", "doc_id").collect()
    assert len(got) == len(texts) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    assert T.score_toxicity(rows.limit(0), labels, "id", "body", "doc_id").count() == 0
    assert {x.score for x in T.score_toxicity(rows, labels.limit(0), "id", "body", "doc_id").collect()} == {0.0}
