"""The ranker against a direct solution, and the rules for abstaining."""

import numpy as np
import pytest

from emberline.operators.ranker import OutcomeHead, TooFewRows


@pytest.fixture(scope="module")
def episodes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2)) * [3, 20] + [1, 50]
    y = (rng.random(240) < 1 / (1 + np.exp(-(x[:, 0] - 1)))).astype(float)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(int(i), float(a), float(b), 7.0, float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id int, a double, b double, flat double, label double")


def newton(x, y):
    """Weights and intercept of the penalised likelihood, features scaled, intercept free."""
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.ones(len(x))])
    w, penalty = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    return z @ w


def pooled(scores, labels):
    """Isotonic fit by adding neighbours that are out of order."""
    blocks = []
    for i in np.argsort(scores):
        blocks.append([labels[i], 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            total, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + n]
    return np.repeat([t / n for t, n in blocks], [n for _, n in blocks])


def test_scores_and_probabilities_equal_a_direct_solution(spark, episodes):
    x, y = episodes
    ranker = OutcomeHead(["a", "b", "flat", "absent"]).fit(frame(spark, x[:140], y[:140]))
    assert ranker.scales["flat"] == 1.0
    got = np.array([r.rank_score for r in ranker.rank_scores(frame(spark, x[:140], y[:140])).orderBy("id").collect()])
    assert np.abs(got - newton(x[:140], y[:140])).max() < 1e-3
    later = frame(spark, x[140:], y[140:])
    assert ranker.calibrate(later)
    held = np.array([r.rank_score for r in ranker.rank_scores(later).orderBy("id").collect()])
    candidates = later.selectExpr("*", "'accepted' status", "cast(array() as array<string>) reasons", "2D anchor_score")
    chances = np.array([r.probability for r in ranker.score(candidates).orderBy("id").collect()])
    assert np.abs(chances[np.argsort(held)] - pooled(held, y[140:])).max() < 1e-5


def test_too_few_examples(spark, episodes):
    x, y = episodes
    with pytest.raises(TooFewRows, match="labelled rows"):
        OutcomeHead(["a"]).fit(frame(spark, x[:59], y[:59]))
    with pytest.raises(TooFewRows, match="label 1"):
        OutcomeHead(["a"]).fit(frame(spark, x[:80], np.zeros(80)))
    ranker = OutcomeHead(["a", "b"]).fit(frame(spark, x, y))
    assert not ranker.calibrate(frame(spark, x[:79], y[:79])) and not ranker.calibrate(frame(spark, x[:90], np.ones(90)))


def test_abstaining(spark, episodes):
    ranker = OutcomeHead(["a", "b"]).fit(frame(spark, *episodes))
    rows = [(1, 1.0, 50.0, "accepted", [], 2.0), (2, 1.0, 50.0, "watch", ["single_repeated_angle"], 1.0), (3, None, None, None, None, None), (4, 1.0, 50.0, "rejected", [], 1.5)]
    got = {r.id: r for r in ranker.score(spark.createDataFrame(rows, "id int, a double, b double, status string, reasons array<string>, anchor_score double")).collect()}
    assert [got[i].abstained for i in (1, 2, 3, 4)] == [False, True, True, True]
    assert [got[i].reason_codes for i in (1, 2, 3, 4)] == [[], ["single_repeated_angle", "no_specific_anchor"], ["evidence_not_accepted", "no_specific_anchor"], ["evidence_not_accepted"]]
    assert all(r.probability is None for r in got.values())
