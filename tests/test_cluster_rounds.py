"""Density clusters whose parts do not fit one task, and blocks that meet."""

import numpy as np
import pytest

from emberline.operators import clusters
from test_clusters import grid_and_copies, plain_leaves, spark_clusters


@pytest.mark.parametrize("seed,least,most,block,ends", [(4, 2, 60, 100, 40), (6, 3, 20, 70, 150)])
def test_rounds_over_many_tasks_equal_the_plain_tree(spark, monkeypatch, seed, least, most, block, ends):
    monkeypatch.setattr(clusters, "BLOCK", block)
    monkeypatch.setattr(clusters, "ENDS", ends)
    x = grid_and_copies(seed)
    assert spark_clusters(spark, x, least, most) == plain_leaves(x, least, most)


def test_jobs_do_not_grow_with_the_depth_of_the_tree(spark):
    """Each point is a little farther from the next than the one before: joins follow each other one by one."""
    chains = [[[100.0 * c + 1.05**i * 20, 0.0] for i in range(30)] for c in (0, 5, 10)]
    x = np.array(chains).reshape(-1, 2)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("depth", "depth")
    try:
        assert spark_clusters(spark, x, 2, 60) == plain_leaves(x, 2, 60)
        assert len(tracker.getJobIdsForGroup("depth")) < 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
