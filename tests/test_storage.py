from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lodestrata import storage


class Elsewhere:
    """A session of a cluster without a shared folder."""

    class sparkContext:
        applicationId, master = "a", "spark://x:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class conf:
        @staticmethod
        def get(name, default=None):
            return default


def test_tables_are_written_named_and_removed(spark):
    with storage.noting() as outer:
        kept = storage.durable(spark.range(5), "kept")
        with storage.noting() as inner:
            storage.durable(spark.range(3), "gone")
    assert len(outer) == 2 and outer[1:] == inner and kept.count() == 5
    storage.remove(spark, *inner)
    assert [os.path.exists(p.removeprefix("file:")) for p in outer] == [True, False]


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="share"):
        storage.work_dir(Elsewhere())


def test_buckets_are_joined_where_they_lie(spark):
    left = storage.durable_by(spark.range(100).withColumn("n", F.col("id") % 7), "buckets", "id", 6)
    right = storage.durable(spark.range(50), "others").hint("merge")
    joined = left.join(right, "id")
    assert joined.count() == 50
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_catalog_entries_go_with_their_files(spark):
    before = {t.name for t in spark.catalog.listTables()}
    with storage.noting() as paths:
        storage.durable_by(spark.range(10), "listed", "id", 2)
        storage.durable_by(spark.range(10), "listed", "id", 2)
    assert len({t.name for t in spark.catalog.listTables()} - before) == 2
    storage.remove(spark, *paths)
    assert {t.name for t in spark.catalog.listTables()} == before
