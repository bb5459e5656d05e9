"""Queries that fit models read sales once, not again for each step of the fit (F7, F8, F9 of round 3)."""

import os

import pytest

from barloom.plans import gauges, learned, panels

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")


def test_features_of_the_walk_forward_are_kept(spark):
    df = learned.labelled(spark, SMALL)
    assert df.storageLevel.useDisk
    df.unpersist()


@pytest.mark.parametrize("name", ["platt_calibration", "variant_errors"])
def test_models_read_kept_rows(spark, name):
    spark.catalog.clearCache()
    query = {**gauges.QUERIES, **panels.QUERIES}[name]
    assert "InMemoryRelation" in query(spark, SMALL)._jdf.queryExecution().withCachedData().toString()
    spark.catalog.clearCache()
