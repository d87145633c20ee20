"""Limits of the baselines."""

from textvane.operators import models


def test_forest_statistics_fit_beside_each_other(spark):
    """Every core of an executor holds the statistics of a group of nodes; four of them stay under half a gigabyte."""
    assert 4 * models.classifier("forest", 100).getMaxMemoryInMB() <= 512
