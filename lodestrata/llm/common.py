"""Shared plumbing: durable intermediate tables and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..storage import durable, durable_by, noting, remove, work_dir

__all__ = ["SPACE_CLASS", "as_bytes", "durable", "durable_by", "noting", "remove", "shuffle_width", "squeezed", "work_dir"]

#: The bytes that separate words: space and the controls 9 to 13.
SPACE_CLASS = r"[ \t-\r]+"


def shuffle_width(spark: SparkSession) -> int:
    """How many ways the session deals a shuffle; buckets are multiples of it, so they grow with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def squeezed(text: Column) -> Column:
    """Text without any separator character; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def as_bytes(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")
