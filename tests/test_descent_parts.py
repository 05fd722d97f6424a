"""Steps over several parts are one stage each, whose sums equal those of a tree and of one part."""

from emberline.operators import descent


def test_parts_make_no_difference(spark, monkeypatch):
    rows = [(i % 7 / 3.0, (i * i) % 11 / 5.0, float((i * 7) % 10 > 4)) for i in range(200)]
    training = spark.createDataFrame(rows, "a double, b double, label double").repartition(4)
    schedule = descent.Schedule(steps=3, slope_steps=3)
    want = descent.fit(training, ["a", "b"], training, schedule=schedule)
    monkeypatch.setattr("pyspark.RDD.treeAggregate", None)
    assert descent.fit(training, ["a", "b"], training, schedule=schedule, part_rows=50) == want
