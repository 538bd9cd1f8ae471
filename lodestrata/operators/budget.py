"""Greedy budgets over ordered groups of any size: what doesn't fit is skipped, later and smaller rows may still fit.

Whether a row fits depends on all rows before it, so this looks like a loop
over the group. But while the rest of the budget lies in [2^k, 2^(k+1)), every
row below 2^k fits and every row of 2^(k+1) or more doesn't; only the first
row in between that fits, or the small rows' sum, ends that phase, and then
the rest is below 2^k. So there are at most log2(budget) phases.

1. Rows are range partitioned by (group, order). Each partition sums and counts
   its rows by power of two: a row for each group, partition and power.
2. A group inside one partition needs no more. For one that spans several, of
   which there are fewer than partitions, the driver adds up the sums of small
   rows: that gives the rest at the start of each partition, as long as the
   phase holds. Partitions that may end it are folded by tasks, all at once,
   and the first one that does gives the rest from which the next phase starts.
3. With the rest at the start of each partition known, all are folded alone.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import durable
from .ranges import in_ranges, n_parts

_KEYS = "_part int, _group string"


def power(n: int) -> int:
    """The k with 2^k <= n < 2^(k+1); -1 for 0."""
    return int(n).bit_length() - 1


def fold(sizes: np.ndarray, rest: int) -> tuple[np.ndarray, int]:
    """(which rows fit, what is left), in order. Between two rows of at least the rest's power of two, small rows are taken at once."""
    fits = np.zeros(len(sizes), bool)
    lo = 0
    while lo < len(sizes):
        k = power(rest)
        part = sizes[lo:]
        small = part < (1 << k) if k >= 0 else part == 0
        left = rest - np.cumsum(np.where(small, part, 0))
        ends = (left < (1 << k) if k >= 0 else np.zeros(len(part), bool)) | (~small & (part <= left))
        at = int(ends.argmax()) if ends.any() else len(part) - 1
        fits[lo : lo + at + 1] = small[: at + 1]
        rest = int(left[at])
        if not small[at] and part[at] <= rest:
            fits[lo + at], rest = True, rest - int(part[at])
        lo += at + 1
    return fits, rest


def _fold_part(table: pa.Table) -> pa.Table:
    """What is left after one group's rows of one partition."""
    order = np.argsort(table.column("_at").to_numpy())
    left = fold(table.column("_size").to_numpy()[order], table.column("_rest")[0].as_py())[1]
    return pa.table({"_part": table.column("_part")[:1], "_group": table.column("_group")[:1], "_left": pa.array([left], pa.int64())})


class _Group:
    """The phases of one group that spans partitions."""

    def __init__(self, budget: int) -> None:
        self.powers: dict[int, dict[int, tuple[int, int]]] = defaultdict(dict)  # partition: power: (sum, least size)
        self.rest, self.starts, self.todo = budget, {}, []

    def candidates(self) -> dict[int, int]:
        """Partitions that may end the phase, with the rest at their start if none before them does. Without any the group is done."""
        k, rest, found = power(self.rest), self.rest, {}
        for part in self.todo:
            self.starts[part] = rest
            sums = self.powers[part]
            left = rest - sum(total for p, (total, _) in sums.items() if p < k)
            if left < (1 << k if k >= 0 else 0) or (k in sums and k >= 0 and sums[k][1] <= rest):
                found[part] = rest
            if left < (1 << k if k >= 0 else 0):
                break
            rest = left
        return found

    def advance(self, left: dict[int, int]) -> None:
        """Takes what is left after each candidate; what lies behind the first that ended the phase is to be done again."""
        k = power(self.rest)
        for part in sorted(left):
            if power(left[part]) < k:
                self.rest, self.todo = left[part], [p for p in self.todo if p > part]
                return
        self.todo = []


def _starts(sized: DataFrame, budget: int) -> list[tuple[int, str, int]]:
    """(partition, group, rest at its start) where a group goes on in a partition.

    Collected: a row for each power of two of groups that span partitions, at
    most two of which meet in any partition, and a row for each candidate.
    """
    spark = sized.sparkSession
    exact_power = F.when(F.col("_size") > 0, F.length(F.bin("_size")) - 1).otherwise(-1)
    sums = durable(sized.groupBy("_part", "_group", exact_power.alias("power")).agg(F.sum("_size").alias("total"), F.min("_size").alias("least")), "budget-sums")
    spread = durable(sums.groupBy("_group").agg(F.min("_part").alias("lo"), F.max("_part").alias("hi")).filter("lo < hi").select(F.col("_group").alias("_spread")), "budget-spread")
    groups: dict[str, _Group] = {}
    for r in sums.join(spread, F.col("_group").eqNullSafe(F.col("_spread"))).collect():
        group = groups.setdefault(r["_group"], _Group(budget))
        group.powers[r["_part"]][r["power"]] = (r["total"], r["least"])
    for group in groups.values():
        group.todo = sorted(group.powers)
    alive = dict(groups)
    while alive:
        rows = [(part, name, rest) for name, group in alive.items() for part, rest in group.candidates().items()]
        if not rows:
            break
        told = spark.createDataFrame(rows, _KEYS + ", _rest long")
        same = sized["_group"].eqNullSafe(told["_group"]) & (sized["_part"] == told["_part"])
        opened = sized.join(F.broadcast(told), same).select(sized["_part"], sized["_group"], "_at", "_size", "_rest")
        left: dict[str, dict[int, int]] = defaultdict(dict)
        for r in opened.groupBy("_part", "_group").applyInArrow(_fold_part, _KEYS + ", _left long").collect():
            left[r["_group"]][r["_part"]] = r["_left"]
        for name in list(alive):
            if name in left:
                alive[name].advance(left[name])
            else:
                del alive[name]
    return [(part, name, rest) for name, group in groups.items() for part, rest in group.starts.items()]


def _fold_groups(budget: int):
    """fits and left of each row of one partition; starts holds the rest of groups that go on here."""

    def run(rows: pa.Table, starts: pa.Table) -> pa.Table:
        rest = dict(zip(starts.column("_group").to_pylist(), starts.column("_rest").to_pylist(), strict=True))
        rows = rows.sort_by("_at")
        names, sizes = rows.column("_group").to_pylist(), rows.column("_size").to_numpy()
        cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
        fits, left = np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        for lo, hi in zip([0, *cuts], [*cuts, len(names)], strict=True):
            if lo == hi:
                continue
            start = rest.get(names[lo], budget)
            fits[lo:hi], _ = fold(sizes[lo:hi], start)
            left[lo:hi] = start - np.cumsum(np.where(fits[lo:hi], sizes[lo:hi], 0))
        return pa.table({"_part": rows.column("_part"), "_at": rows.column("_at"), "fits": pa.array(fits), "left": pa.array(left)})

    return run


def within_budget(rows: DataFrame, group: str | Column, order: list[str | Column], size: str | Column, budget: int, parts: int | None = None) -> DataFrame:
    """rows with fits and left: whether the row is within its group's budget, and what is left of it after the row.

    Within a group rows are taken in the given order, which should leave no
    ties; equal rows come in any order. A row fits if its size (null: 0) is at
    most what the rows before it left. Sizes and the budget are not negative.
    Rows with a null group form one group. No rows give no rows. A group may
    have all rows: it is dealt over partitions by its order.
    """
    if budget < 0:
        raise ValueError("a budget is not negative")
    named = rows.withColumns({"_group": (F.col(group) if isinstance(group, str) else group).cast("string"), "_size": F.coalesce(F.col(size) if isinstance(size, str) else size, F.lit(0)).cast("long")})
    ranged = in_ranges(named, ["_group"], order, parts or n_parts(named), "budget-rows")
    sized = ranged.select("_part", "_group", "_at", "_size")
    starts = rows.sparkSession.createDataFrame(_starts(sized, budget), _KEYS + ", _rest long")
    folded = sized.groupBy("_part").cogroup(starts.groupBy("_part")).applyInArrow(_fold_groups(budget), "_part int, _at long, fits boolean, left long")
    return ranged.join(durable(folded, "budget-folded"), ["_part", "_at"]).select(*rows.columns, "fits", "left")
