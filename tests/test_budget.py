"""Greedy budgets and places against plain loops."""

import random

import numpy as np
import pytest

from lodestrata.operators.budget import fold, within_budget
from lodestrata.operators.ranges import places


def loop(sizes, rest):
    fits = []
    for size in sizes:
        fits.append(size <= rest)
        rest -= size if size <= rest else 0
    return fits, rest


def test_fold():
    rng = random.Random(1)
    for _ in range(500):
        sizes = [rng.choice([0, 1, 2, 3, rng.randint(0, 50), rng.randint(0, 5000)]) for _ in range(rng.randint(0, 40))]
        budget = rng.choice([0, 1, 7, 100, 3000, 1 << 40])
        fits, rest = fold(np.array(sizes, np.int64), budget)
        assert (fits.tolist(), rest) == loop(sizes, budget)


@pytest.mark.parametrize("budget", [0, 5, 1000, 40_000, 10**12])
def test_groups_of_all_sizes(spark, budget):
    rng = random.Random(budget)
    rows = [(g, i, rng.choice([0, 1, rng.randint(1, 60), rng.randint(1, 9000), None])) for g, n in (("a", 1500), ("b", 3), (None, 40), ("c", 400), ("", 1)) for i in range(n)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "g string, i long, size int, _part int, rest string").drop("_part")
    got = {(r.g, r.i): (r.fits, r.left) for r in within_budget(df.repartition(5), "g", ["i"], "size", budget, parts=23).collect()}
    assert len(got) == len(rows)
    for name in {g for g, *_ in rows}:
        rest = budget
        for _, i, size in sorted(r for r in rows if r[0] == name):
            fits = (size or 0) <= rest
            rest -= (size or 0) if fits else 0
            assert got[name, i] == (fits, rest)


def test_no_rows(spark):
    assert within_budget(spark.createDataFrame([], "g string, i long, size long"), "g", ["i"], "size", 10).collect() == []


def test_places_of_a_group_over_many_partitions(spark):
    rows = [("hot", i, i % 7) for i in range(2000)] + [(None, i, 0) for i in range(9)] + [(f"g{i}", i, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i long, x int").repartition(6)
    got = {(r.g, r.i): r.place for r in places(df, ["g"], [df["x"].desc(), "i"], parts=31).collect()}
    for name in {g for g, *_ in rows}:
        own = sorted((-x, i) for g, i, x in rows if g == name)
        assert [got[name, i] for _, i in own] == list(range(1, len(own) + 1))
