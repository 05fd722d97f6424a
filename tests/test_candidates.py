"""Feature vectors against the formulas in plain Python, and candidates that the future does not change."""

import math
import random
from collections import Counter
from datetime import UTC, datetime, timedelta
from statistics import median

import pytest

from emberline.operators.adoption import SeenTooLate
from emberline.operators.candidates import FEATURES, build_candidates, feature_vectors

AS_OF = datetime(2024, 1, 24, tzinfo=UTC)
MEMBER, SEEN = "topic string, channel string, published_at timestamp, lift double", "topic string, channel string, published_at timestamp"


def plain(topic, members, history, terms, verdict, known):
    own = [m for m in members if m[0] == topic]
    floor, earlier = AS_OF - timedelta(days=7), AS_OF - timedelta(days=28)
    recent, previous = [m for m in own if m[2] >= floor], [m for m in own if earlier <= m[2] < floor]
    weekly, counts = len(previous) / 4, Counter(m[1] for m in own)
    now, old = {m[1] for m in recent}, {h[1] for h in history if h[0] == topic and h[2] < floor}
    lifts = [m[3] for m in own if m[3] is not None]
    entropy = -sum(c / len(own) * math.log(c / len(own)) for c in counts.values()) / math.log(len(counts)) if len(counts) > 1 else 0
    best = [t for t in terms if t[0] == topic]
    return {
        "log_active_supply": math.log1p(len(own)), "log_recent_supply": math.log1p(len(recent)), "log_previous_weekly_supply": math.log1p(weekly), "supply_acceleration": min(6, max(-2, (len(recent) - weekly) / max(weekly, 1))),
        "log_distinct_creators": math.log1p(len(counts)), "creator_diversity": len(counts) / len(own), "recent_creator_share": len(now) / max(len(counts), 1), "new_creator_share": len(now - old) / max(len(now), 1),
        "channel_entropy": entropy, "mean_similarity": known[1], "minimum_similarity": known[2], "anchor_score_max": max((t[1] for t in best), default=0), "anchor_novelty_max": max((t[2] for t in best), default=0),
        "anchor_channel_support": max((t[3] for t in best), default=0), "angle_diversity": verdict[1], "copy_family_ratio": verdict[2], "independent_channels": verdict[3], "has_view_baseline": float(bool(lifts)),
        "median_normalized_lift": median(lifts) if lifts else 0, "positive_lift_share": sum(x > 0 for x in lifts) / len(lifts) if lifts else 0, "log_topic_age_days": math.log1p(max(known[3], 0)),
    }


def frames(spark, members, history, terms, verdicts, topics):
    schemas = (MEMBER, SEEN, "topic string, score double, novelty double, support int", "topic string, angle_diversity double, copy_ratio double, independent_channels int", "topic string, mean_similarity double, minimum_similarity double, age_days double")
    return [spark.createDataFrame(rows, schema) for rows, schema in zip((members, history, terms, verdicts, topics), schemas)]


def test_vectors_equal_the_formulas(spark):
    rng = random.Random(11)
    topics = ["a", "b", "c", "quiet"]
    when = lambda: AS_OF - timedelta(hours=rng.choice([0, 24 * 7, rng.randrange(24 * 40)]))
    members = [(rng.choice("abc"), f"c{rng.randrange(6)}", when(), rng.choice([None, rng.uniform(-1, 1)])) for _ in range(70)] + [("quiet", "c1", AS_OF - timedelta(days=30), None)]
    history = [(rng.choice("abc"), f"c{rng.randrange(6)}", when()) for _ in range(20)] + [(None, "c1", AS_OF)]
    terms = [(rng.choice("ab"), rng.random() * 9, rng.random(), rng.randrange(5)) for _ in range(9)]
    verdicts, known = [(t, rng.random(), rng.random(), rng.randrange(9)) for t in topics], [(t, rng.random(), rng.random(), rng.uniform(-1, 9)) for t in topics]
    got = {r.topic: r.asDict() for r in feature_vectors(*frames(spark, members + [(None, "x", AS_OF, 1.0)], history, terms, verdicts, known), AS_OF).collect()}
    assert set(got) == set(topics)
    for t, v, k in zip(topics, verdicts, known):
        expected = plain(t, members, history, terms, v, k)
        assert {n: got[t][n] for n in expected} == pytest.approx(expected, abs=2e-6)
        assert set(got[t]) == {"topic", *FEATURES}
    late = frames(spark, [*members, ("a", "c", AS_OF + timedelta(seconds=1), None)], history, terms, verdicts, known)
    with pytest.raises(SeenTooLate):
        feature_vectors(*late, AS_OF)
    assert feature_vectors(*[f.limit(0) for f in frames(spark, members, history, terms, verdicts, known)], AS_OF).count() == 0


def test_the_future_changes_no_candidate(spark):
    rng = random.Random(12)
    near = lambda c, i: [c * 1.0 + 0.01 * (i % 3), 1.0 - c + 0.02 * (i % 2), 0.3 * c]
    videos, vectors = [], []
    for i in range(16):
        c = i % 2
        videos.append((i, f"ch{i % 5}", f"{'zeta nova launch' if c else 'kilo lima build'} part{i} note{rng.randrange(90)}", AS_OF - timedelta(days=i), 0.1 * i - 0.5))
        vectors.append((i, near(c, i // 2)))
    future = [(100 + i, "ch9", "zeta nova again", AS_OF + timedelta(days=1 + i), 5.0) for i in range(6)]
    schema = "id bigint, channel string, title string, published_at timestamp, lift double"
    both = [build_candidates(spark.createDataFrame(videos + more, schema), spark.createDataFrame(vectors + [(100 + i, near(1, i)) for i in range(6)], "id bigint, vector array<double>"), AS_OF) for more in ([], future)]
    first, second = (sorted(map(tuple, f.collect())) for f in both)
    assert first and first == second
    assert sum(r[5] for r in first) <= len(videos)
