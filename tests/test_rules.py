"""Comment classes, entities, microtopics and greedy terms by hand and against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.operators.rules import COMMENT_RULES, DOMAINS, FACETS, PRODUCTS, REQUESTS, classify, groups_in, microtopic_members, microtopics, one_line, ranked_terms, with_entities

# text, class, spam, demand, sentiment: worked out by hand
COMMENTS = [
    ("How much does it cost?", "pricing_request", 0.02, round(0.93 * 0.98, 4), "neutral"),
    ("Is my PRIVATE   data safe, and what is the price?", "privacy_safety_concern", 0.02, round(0.93 * 0.98, 4), "negative"),
    ("the price went up again today", "emotional_reaction", 0.02, round(0.12 * 0.98, 4), "neutral"),
    ("please explain the last part", "request_for_explanation", 0.02, round(0.86 * 0.98, 4), "neutral"),
    ("However you see it there is hype", "skepticism", 0.02, round(0.72 * 0.98, 4), "negative"),
    ("However you see it", "emotional_reaction", 0.02, round(0.12 * 0.98, 4), "neutral"),
    ("how, then, did this end", "explicit_question", 0.02, round(0.78 * 0.98, 4), "neutral"),
    ("Thank you so much", "generic_praise", 0.02, round(0.05 * 0.98, 4), "positive"),
    ("subscribe at https://a.example www.b.example", "spam_irrelevant", 0.97, 0.0, "neutral"),
    ("i love the sound of this soooooooo", "emotional_reaction", 0.27, round(0.12 * 0.73, 4), "positive"),
    ("ok", "spam_irrelevant", 0.82, 0.0, "neutral"),
    ("", "spam_irrelevant", 0.82, 0.0, "neutral"),
    (None, "spam_irrelevant", 0.82, 0.0, "neutral"),
]


def test_comments_by_hand(spark):
    rows = [(i, c[0], "old") for i, c in enumerate(COMMENTS)] * 2
    found = classify(spark.createDataFrame(rows, "id int, text string, taxonomy string")).collect()
    assert len(found) == len(rows)
    for r in found:
        _, kind, spam, demand, sentiment = COMMENTS[r.id]
        assert (r.taxonomy, r.sentiment) == (kind, sentiment), r
        assert r.spam == pytest.approx(spam, abs=1e-9) and r.demand == pytest.approx(demand, abs=1e-9), r
        assert list(r.matched) == sorted(r.matched) and r.matched[-1] == len(COMMENT_RULES) - 1
    assert classify(spark.createDataFrame([], "text string")).count() == 0


def test_white_space_and_long_texts(spark):
    texts = [" Great  video\x1f\n", "x" * 500_000 + " deal\n\nbreaker"]
    found = classify(spark.createDataFrame([(t,) for t in texts], "text string").withColumn("line", one_line(F.col("text")))).collect()
    assert found[0].line == "great video" and found[0].taxonomy == "generic_praise"
    assert found[1].taxonomy == "objection" and found[1].spam == pytest.approx(0.27)


def test_automaton_equals_a_search_for_each_phrase(spark):
    draw = random.Random(7)
    groups = [r.phrases for r in COMMENT_RULES] + [REQUESTS, ("abab", "ba"), ("ab",), ("ab", "é b")]
    pieces = [p for g in groups for p in g] + ["a", "b", " ", "é", "ab"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 9))) for _ in range(300)]
    found = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "t string").repartition(3).select("t", groups_in(F.col("t"), groups).alias("g")).collect()
    for r in found:
        assert list(r.g) == [i for i, g in enumerate(groups) if any(p in (r.t or "") for p in g)]


def entities_of(spark, rows):
    return with_entities(spark.createDataFrame(rows, "doc_id int, title string, description string, entities string"))


def test_entities_by_hand(spark):
    rows = [
        (1, "Claude Code vs Grok: coding agents", "a text-to-video tool", "old"),
        (2, "Unsafe Wan2 robotics", None, None),
        (3, None, "China's new AI, OpenAI", None),
        (4, "", "x " * 400 + "humanoid", None),
        (5, None, None, None),
    ]
    found = {r.doc_id: r for r in entities_of(spark, rows).collect()}
    assert found[1].products == ["Claude Code", "Claude", "Grok"]
    assert found[1].entities == ["Claude Code", "Claude", "Grok", "Coding agents", "AI video generation", "Developer tools"]
    assert found[2].products == ["Wan"] and found[2].entities == ["Wan", "AI robotics"]
    assert found[3].products == [] and found[3].entities == ["Chinese AI models"]
    assert found[4].entities == [] and found[5].entities == []
    assert len({r.name for r in PRODUCTS + DOMAINS}) == len(PRODUCTS) + len(DOMAINS)


def test_microtopics_by_hand(spark):
    rows = [
        (1, "Sora vs Veo: best ai video", "", None),
        (2, "Sora vs Veo, ai video again", "", None),
        (2, "Sora vs Veo, ai video again", "", None),
        (3, "Is this the best ai video?", "", None),  # a comparison without a product
        (4, "A free workflow for beginners", "ai agent", None),  # neither is named, both say little: more words
        (7, "A free workflow for beginners", "", None),
        (5, "An unlimited workflow", "", None),
        (6, "Sora is ai video", "", None),  # no facet
        (None, "A free workflow", "", None),
    ]
    members = microtopic_members(entities_of(spark, rows))
    assert sorted((r.doc_id or 0, r.domain, r.facet, r.anchor) for r in members.collect()) == [
        (0, "Productivity", "free_local", None), (1, "AI video generation", "comparison", "Sora vs Veo"), (2, "AI video generation", "comparison", "Sora vs Veo"), (2, "AI video generation", "comparison", "Sora vs Veo"),
        (4, "AI agents", "free_local", None), (5, "Productivity", "free_local", None), (7, "Productivity", "free_local", None),
    ]
    found = {r.alias: r for r in microtopics(members).collect()}
    first, second = found["Compared AI video generation"], found["Free, local and unlimited Productivity"]
    assert (first.label, first.n_documents, first.specificity) == ("Sora vs Veo comparison", 2, 56 + 8 + 15 + 12)
    assert list(first.entities) == ["AI video generation", "Sora vs Veo", "Sora", "Veo"]
    assert (second.label, second.n_documents, second.specificity) == ("Free, local and unlimited Productivity", 2, 56 + 8 + 5)
    assert microtopics(members.filter("false")).count() == 0 and len(FACETS) == 8


def plain_terms(weights, most):
    best = {}
    for term, w in weights:
        best[term] = max(w, best.get(term, w))
    chosen = []
    for term in sorted(best, key=lambda t: (-best[t] * (1.15 if " " in t else 1.0), t)):
        words = set(term.split(" "))
        if len(chosen) < most and not any(words < set(c.split(" ")) or set(c.split(" ")) < words for c in chosen):
            chosen.append(term)
    return chosen


def test_greedy_terms_equal_the_loop(spark):
    draw = random.Random(11)
    rows = []
    for group in range(12):
        for _ in range(draw.randint(1, 60)):
            rows.append((group, " ".join(draw.choice("abcdefg") for _ in range(draw.randint(1, 3))), float(draw.randint(1, 6))))
    extra = [(None, "a", 9.0), (1, None, 9.0), (1, "z", None)]
    found = ranked_terms(spark.createDataFrame(rows + extra, "source int, term string, weight double").repartition(5), 5).collect()
    for group in {g for g, *_ in rows}:
        got = [r.term for r in sorted((r for r in found if r.source == group), key=lambda r: r.rank)]
        assert got == plain_terms([(t, w) for g, t, w in rows if g == group], 5)
    assert not [r for r in found if r.source is None]
    assert ranked_terms(spark.createDataFrame([], "source int, term string, weight double"), 3).count() == 0
