"""Anchors with clusters counted in one task each, and with terms moved, are the same; terms are not moved for small clusters."""

import random

from emberline.operators import anchors as module


def test_large_and_small_clusters_agree(spark, monkeypatch, capsys):
    draw = random.Random(15)
    words = [f"w{i}" for i in range(300)]
    rows = [(draw.choice([1, 2, 3, None]), draw.choice(["a", "b", "c", None]), " ".join(draw.choices(words, k=draw.randint(0, 25))) or None, draw.choice([-1, 0, 30, 365, 366, None])) for _ in range(160)]
    documents = spark.createDataFrame(rows, "cluster bigint, support_key string, text string, age_days int")
    want = sorted(map(tuple, module.anchors(documents, 50).collect()))
    sizes = documents.groupBy("cluster").count().selectExpr("cluster", "10 AS bytes")
    module._supported(documents.filter("cluster is not null"), sizes, 1).explain()
    assert capsys.readouterr().out.count("Exchange") == 1 and want
    for name, value in (("LOCAL", 0), ("MOST_BROADCAST", 0)):
        monkeypatch.setattr(module, name, value)
        assert sorted(map(tuple, module.anchors(documents, 50).collect())) == want
