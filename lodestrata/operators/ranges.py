"""Order within groups of any size: range partitions, and what is before each of them.

Rows are dealt by ranges of (group, order) and sorted there, so that a group
may lie in many partitions. The only thing that partitions have to be told is
how many rows, or how much of a sum, the ones before them hold, which is one
row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable

#: Rows of a partition that is sorted, and the bits of a row's number that say its place in it.
PART_ROWS, PLACE_BITS = 1 << 20, 33


def n_parts(rows: DataFrame) -> int:
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART_ROWS + 1)


def in_ranges(rows: DataFrame, group: list[str | Column], order: list[str | Column], parts: int | None = None, label: str = "ranges") -> DataFrame:
    """rows, written in order, with _part and _at: the number of their range partition and their place in it, from 0. By default there are as many partitions as the session deals a shuffle in."""
    keys = [*group, *order]
    dealt = (rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    number = dealt.withColumn("_row", F.monotonically_increasing_id())
    split = number.withColumns({"_part": F.shiftright("_row", PLACE_BITS).cast("int"), "_at": F.col("_row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})
    return durable(split.drop("_row"), label)


def with_global_place(ranged: DataFrame, name: str = "_global") -> DataFrame:
    """Rows of in_ranges with their place in all of them, from 0. Broadcast: one row for each partition."""
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, before = [], 0
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    table = ranged.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return ranged.join(F.broadcast(table), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_before")


def places(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """rows with their place in their group, from 1. A group may have any number of rows; equal rows are numbered in any order.

    A row's place in all rows is its partition's offset and its place there; a
    group's first place is a minimum that is combined before the shuffle.
    """
    ranged = with_global_place(in_ranges(rows, group, order, parts, "places"))
    named = [F.col(g).alias(f"_group{i}") for i, g in enumerate(group)]
    first = durable(ranged.groupBy(*named).agg(F.min("_global").alias("_first")), "places-first")
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & ranged[g].eqNullSafe(first[f"_group{i}"])
    return ranged.join(first, same).withColumn(name, F.col("_global") - F.col("_first") + 1).select(*rows.columns, name)
