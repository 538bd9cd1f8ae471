"""Joins with keys that very many rows have."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it has more than one row in SHARE; so there are fewer than SHARE of them. Its rows are dealt over DEALS keys.
SHARE, DEALS = 64, 32


def heavy_hashes(df: DataFrame, *keys: str) -> list[int]:
    """Hashes of the heavy keys of df, fewer than SHARE. A light key that has the same hash is dealt too, which does no harm."""
    counts = df.groupBy(F.xxhash64(*keys).alias("h")).agg(F.count("*").alias("n"))
    total = df.count()
    return [r.h for r in counts.filter(F.col("n") * SHARE > total).select("h").collect()]


def dealt(many: DataFrame, one: DataFrame, keys: Sequence[str], hot: list[int], by: Column) -> tuple[DataFrame, DataFrame]:
    """many and one (a row for each key) with a further join key `deal`: rows of many with a heavy key are spread by `by`, rows of one with such a key are repeated for each deal."""
    is_hot = F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
    spread = many.withColumn("deal", F.when(is_hot, F.pmod(by, F.lit(DEALS)).cast("int")).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(DEALS - 1))).otherwise(F.array(F.lit(0)))
    return spread, one.withColumn("deal", F.explode(copies))
